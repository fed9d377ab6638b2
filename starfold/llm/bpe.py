"""BPE over a contiguous rank array, with a bounded cache of words.

A word is held as two flat lists: the ids between its remaining part boundaries, and the merge rank of each pair of
neighbours.  One step scans the ranks for the minimum (the leftmost on ties), deletes that boundary, and refreshes the
ranks to its left and right.  That is quadratic, but words are short; from ``LONG`` parts on, a heap over a linked list
takes the place of the scan and gives the same merges.
"""

from __future__ import annotations

import functools
import gc
import heapq
import json
import re
import unicodedata
from array import array
from itertools import islice

import numpy as np

LONG = 400  # parts of a word from which on the heap is used
WIDE = 32  # parts up to which words are merged many at a time
CACHE = 300_000  # words kept for good; later ones are kept until RECENT more have come
RECENT = 100_000
BLOCK = 256  # texts whose words are looked up together
NEVER = 1 << 30


@functools.cache
def categories() -> np.ndarray:
    """The general category of every character, as two bytes."""
    return np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), "S2")


def char_class(chars: set[int], kind: str) -> str:
    """A character class, as ranges that the standard ``re`` can compile: this general category, and ``chars``."""
    member = np.zeros(0x110002, np.int8)
    member[1:-1] = categories().view("S1")[::2] == kind.encode()
    member[[c + 1 for c in chars]] = 1
    step = np.diff(member)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True))


def newer_characters(library) -> tuple[set[int], set[int], dict[int, str]]:
    """(letters, numbers, normal forms) of characters that the library's Unicode version has and Python's lacks."""
    import regex

    every = "".join(map(chr, np.flatnonzero(categories() == b"Cn").tolist()))
    new = regex.findall(r"[\p{L}\p{N}]", every)
    pieces = lambda x: len(library.pre_tokenizer.pre_tokenize_str(x))
    letters = {ord(c) for c in new if pieces("a" + c) == 1}
    numbers = {ord(c) for c in new if ord(c) not in letters and pieces("!" + c) == 2}
    normal = library.normalizer and {ord(c): n for c in new if (n := library.normalizer.normalize_str(c)) != c}
    return letters, numbers, normal or {}


# The split patterns of the two vocabularies (L: letters, N: numbers, S: white space).
BYTE_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^SLN]+"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


# A text is first cut at white space, which no pattern crosses but for one leading space; only chunks that the cache lacks meet the full pattern.
BYTE_CHUNK = " ?[^S]+|[S]+(?![^S])|[S]+"
STOPS = frozenset(".,;:!?)")
ODD_SPACES = "\x1c\x1d\x1e\x1f"  # these part words for str.split, but are no white space here

OTHER_SPACE = re.compile("[S]".replace("S", WHITE.replace("\\t-\\r ", "\\t\\x0b-\\r")))


def single_spaced(text: str) -> bool:
    """Whether every space stands alone between two characters that are no white space (other white space: a newline at most)."""
    return not (text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text))


def odd_space(text: str) -> bool:
    return any(c in text for c in ODD_SPACES)  # four plain searches are faster than one of a class


def splitter(pattern: str, letters: set[int], numbers: set[int]):
    letters, numbers = char_class(letters, "L"), char_class(numbers, "N")
    return re.compile(re.sub(r"[LNS](?=[LNS]*\])", lambda m: {"L": letters, "N": numbers, "S": WHITE}[m[0]], pattern))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case character by character (no final-sigma rule)."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Known(dict):
    """A cache of what ``make`` says of a key: look-ups make what they lack."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        made = self[key] = self.make(key)
        return made


class Bpe:
    """One vocabulary file: ``encode`` gives the ids of a text as a numpy array, ``decode`` the text of ids.

    ``own_merges`` merges by the rank array; otherwise the tokenizers library encodes every word that the cache lacks.
    Special tokens written in a text become their single id, as the library does by default.
    """

    def __init__(self, path: str, own_merges: bool = True):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.words = (spec.get("normalizer") or {}).get("type") == "Sequence"
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.find_special = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        self.chunks = re.compile(BYTE_CHUNK.replace("S", WHITE)).findall
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        letters, numbers, self.newer = newer_characters(library)
        self.find_newer = re.compile("[" + "".join(map(chr, self.newer)) + "]") if self.newer else None
        self.split = splitter(WORD_PATTERN if self.words else BYTE_PATTERN, letters, numbers).findall
        self.alphabet = byte_alphabet()
        self.byte_id = [vocab.get(c) for c in self.alphabet]
        self.last_id = [vocab.get(c + self.suffix) for c in self.alphabet]
        self.first_ids, self.final_ids = (np.array([-1 if i is None else i for i in x], np.int32) for x in (self.byte_id, self.last_id))
        self.library = None
        if own_merges:
            self.rank = {}
            for r, m in enumerate(model["merges"]):
                a, b = m.split(" ") if isinstance(m, str) else m
                self.rank[vocab[a] << 20 | vocab[b]] = (r, vocab[a + b])
            self._tabulate()
        else:
            self.library, self.tokenize = library, library.model.tokenize
            self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.of_bytes = dict(enumerate(self.alphabet))
        self.vocab = vocab
        self.cache: dict[str, bytes] = {} if own_merges else Known(lambda c: self.chunk_ids(c, ""))
        self.spaced: dict[str, bytes] = {} if own_merges else Known(lambda c: self.chunk_ids(c, " "))  # chunks that one space leads, without it
        self.parts = Known(self.library_ids)  # words out of chunks that hold several

    @functools.cached_property
    def bytes_of(self) -> list[bytes]:
        """The bytes that each id stands for."""
        code = {c: b for b, c in enumerate(self.alphabet)}
        out = [b""] * self.size
        for token, i in self.vocab.items():
            out[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        for token, i in self.special.items():
            out[i] = token.encode()
        return out

    @functools.cached_property
    def decimal(self) -> list[str]:
        return [str(i) for i in range(self.size)]

    def _tabulate(self) -> None:
        """The merges as flat arrays for look-ups of many pairs at once: open addressing, one array per probe."""
        keys = np.array(list(self.rank), np.int64)
        rank, made = (np.array([v[k] for v in self.rank.values()], np.int32) for k in (0, 1))
        self.probes, self.made_by_rank = [], np.zeros(len(keys), np.int32)
        self.made_by_rank[rank] = made
        left = np.arange(len(keys))
        while len(left):
            slot = self._slot(keys[left], len(self.probes))
            table_key, table_rank = np.full(1 << 18, -1, np.int64), np.full(1 << 18, NEVER, np.int32)
            first = np.unique(slot, return_index=True)[1]
            table_key[slot[first]], table_rank[slot[first]] = keys[left[first]], rank[left[first]]
            self.probes.append((table_key, table_rank))
            left = np.delete(left, first)

    @staticmethod
    def _slot(keys, probe: int):
        return ((keys * (0x9E3779B97F4A7C15 - (1 << 64) + 2 * probe)) >> 46) & ((1 << 18) - 1)

    def _ranks(self, left, right):
        """Merge ranks of pairs of ids; NEVER where there is no merge or no pair (id -1)."""
        keys = (left.astype(np.int64) << 20) | right
        keys[(left < 0) | (right < 0)] = -2
        out = np.full(keys.shape, NEVER, np.int32)
        flat, at, todo = out.reshape(-1), keys.reshape(-1), None
        todo = np.flatnonzero(at >= 0)
        for n, (table_key, table_rank) in enumerate(self.probes):
            k = at[todo]
            slot = self._slot(k, n)
            found = table_key[slot]
            hit = found == k
            flat[todo[hit]] = table_rank[slot[hit]]
            todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
        return out

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (as bytes) of many words of WIDE bytes at most: the rank array of each is a row of one matrix."""
        n = len(words)
        size = np.array([len(w) for w in words])
        wide = int(size.max(initial=1))
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(n, wide)
        col = np.arange(wide)
        parts = np.where(col < size[:, None], self.first_ids[raw], -1).astype(np.int32)
        rows = np.arange(n)
        parts[rows, size - 1] = self.final_ids[raw[rows, size - 1]]
        ranks = np.full((n, wide), NEVER, np.int32)
        ranks[:, :-1] = self._ranks(parts[:, :-1], parts[:, 1:])
        live = rows
        p, r = parts, ranks
        while len(live):
            i = r.argmin(1)
            k = np.arange(len(live))
            least = r[k, i]
            go = least < NEVER
            if not go.all():
                parts[live[~go]] = p[~go]
                live, p, r, i, least = live[go], p[go], r[go], i[go], least[go]
                k = np.arange(len(live))
                if not len(live):
                    break
            p[k, i] = self.made_by_rank[least]
            w = p.shape[1]
            shift = col[:w] + (col[:w] > i[:, None])
            shift[:, -1] = np.minimum(shift[:, -1], w - 1)
            p, r = np.take_along_axis(p, shift, 1), np.take_along_axis(r, np.minimum(col[:w] + (col[:w] >= i[:, None]), w - 1), 1)
            p[:, -1], r[:, -1] = -1, NEVER
            has = np.flatnonzero(i > 0)
            r[has, i[has] - 1] = self._ranks(p[has, i[has] - 1], p[has, i[has]])
            has = np.flatnonzero(i < w - 1)
            r[has, i[has]] = self._ranks(p[has, i[has]], p[has, i[has] + 1])
        kept = parts >= 0
        flat, ends = parts[kept].astype(self.dtype).tobytes(), (np.cumsum(kept.sum(1)) * self.dtype.itemsize).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_word(self, word: bytes) -> list[int]:
        """The ids of one word, by the rank array."""
        parts = [self.byte_id[b] for b in word]
        if parts:
            parts[-1] = self.last_id[word[-1]]
        n = len(parts)
        if n > LONG:
            return self.merge_long(parts)
        get, none = self.rank.get, (NEVER, 0)
        ranks = [get(parts[i] << 20 | parts[i + 1], none)[0] for i in range(n - 1)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = get(parts[i] << 20 | parts[i + 1])[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], none)[0]
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], none)[0]
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: a heap of (rank, place) over a linked list, in n log n."""
        n = len(parts)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (hit := self.rank.get(parts[i] << 20 | parts[after[i]])):
                heapq.heappush(heap, (hit[0], i, parts[i], parts[after[i]], hit[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j] = made, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p, keep in zip(parts, alive, strict=True) if keep]

    def library_ids(self, w: str, lead: str = "") -> bytes:
        """Ids of ``lead`` and a word by the library's model."""
        if not (w.isascii() and w.isalnum()):  # other printable bytes stand for themselves
            w = w.encode().decode("latin-1").translate(self.of_bytes)
        return array(self.kind, [t.id for t in self.tokenize(self.alphabet[32] + w if lead else w)]).tobytes()

    def chunk_ids(self, chunk: str, lead: str) -> bytes:
        """Ids of ``lead`` and a chunk by the library's model; letters alone, or with one stop after them, need no pattern."""
        x, known = chunk, self.spaced if lead else self.cache
        if self.words:
            x = lower(x if x.isascii() else unicodedata.normalize("NFC", x))
            if not x.isascii():
                known = self.parts  # these are not normalised again
        if x.isalpha():
            return self.library_ids(x, lead) if x == chunk else known[x]
        if x[-1:] in STOPS and x[:-1].isalpha():
            return known[x[:-1]] + self.parts[x[-1]]
        return b"".join(map(self.parts.__getitem__, self.pieces(lead + chunk)))

    def learn(self, missing: list[str]) -> None:
        """Put words into the cache."""
        short = []
        for w in missing:
            raw = w.encode()
            if len(raw) <= WIDE:
                short.append((w, raw))
            else:
                self.cache[w] = np.array(self.merge_word(raw), self.dtype).tobytes()
        short.sort(key=lambda x: len(x[1]))
        for i in range(0, len(short), 2048):
            block = short[i : i + 2048]
            self.cache.update(zip([w for w, _ in block], self.merge_words([raw for _, raw in block]), strict=True))

    def chunk_pieces(self, chunk: str, lead: str) -> list[str]:
        """``pieces`` of ``lead`` (nothing or one space) and a chunk; letters alone, or with one stop after them, need no pattern."""
        if self.words:
            chunk = lower(chunk)
        if chunk.isascii():
            if chunk.isalpha():
                return [lead + chunk]
            if chunk[-1:] in STOPS and chunk[:-1].isalpha():
                return [lead + chunk[:-1], chunk[-1]]
        return self.pieces(lead + chunk)

    def pieces(self, text: str) -> list[str]:
        if self.words:  # white space only parts words, so runs of it need no change
            if self.find_newer is not None and self.find_newer.search(text):
                text = text.translate(self.newer)
            text = lower(text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text))
        return self.split(text)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts (null or empty: none); words that the cache lacks are merged together."""
        collects = gc.isenabled()
        gc.disable()  # millions of short-lived lists, none in a cycle, would make the collector walk the caches
        try:
            return self._encode_many(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_many(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), BLOCK):
            parts, words, spaced = [], [], []
            for t in texts[at : at + BLOCK]:
                t = t or ""
                cut = self.find_special.split(t) if self.find_special is not None and "<|" in t else [t]
                for x in cut[::2]:
                    if self.words:
                        words.append(self.pieces(x) if odd_space(x) else x.split())
                        spaced.append(())
                    elif not single_spaced(x):
                        words.append(self.chunks(x))
                        spaced.append(())
                    else:  # single spaces between other characters: each leads the chunk after it
                        rest = x.split(" ")
                        words.append(rest[:1] if x else [])
                        spaced.append(rest[1:])
                parts.append(cut)
            for kept in (self.cache, self.spaced, self.parts):
                if len(kept) > CACHE + RECENT:  # entries past CACHE are recent ones: they go when RECENT of them have come
                    for w in list(islice(kept, CACHE, None)):
                        del kept[w]
            get, get_spaced = self.cache.__getitem__, self.spaced.__getitem__
            fresh = () if self.library is not None else [(self.cache, "", set().union(*words).difference(self.cache)), (self.spaced, " ", set().union(*spaced).difference(self.spaced))]
            if fresh and (fresh[0][2] or fresh[1][2]):
                cut_up = [[(c, self.chunk_pieces(c, lead)) for c in new] for _, lead, new in fresh]
                self.learn(list({w for cuts in cut_up for _, cut in cuts for w in cut}.difference(self.cache)))
                for (dest, _, _), cuts in zip(fresh, cut_up, strict=True):
                    dest.update([(c, get(cut[0]) if len(cut) == 1 else b"".join(map(get, cut))) for c, cut in cuts])
            made = zip(words, spaced, strict=True)
            for cut in parts:
                raw = []
                for i, x in enumerate(cut):
                    if i % 2:
                        raw.append(np.array([self.special[x]], self.dtype).tobytes())
                    else:
                        w, rest = next(made)
                        raw.append(b"".join(map(get, w)))
                        raw.append(b"".join(map(get_spaced, rest)))
                out.append(np.frombuffer(b"".join(raw), self.dtype))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[tuple[str, bool], Bpe] = {}


def load(path: str, own_merges: bool = True) -> Bpe:
    """The vocabulary of this process, read once."""
    if (path, own_merges) not in _loaded:
        _loaded[path, own_merges] = Bpe(path, own_merges)
    return _loaded[path, own_merges]
