"""The template fit as a function of Spark's JVM: the kernels of ``fit`` in Java, compiled in memory by the compiler that Spark ships.

They take the same steps as ``fit.fit_dusty`` and ``fit.fit_offsets``, with the starts of many trials side by side in place of
passes over arrays.  The move of a step follows from sums, not from residuals, and short templates are lines with bends, not tables,
so last digits may differ.  The class goes to the executors as a jar, as Spark's ``ADD JAR`` sends it.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

from .templates import Template

SOURCE = r"""
package starfold;

public class @NAME@ implements org.apache.spark.sql.api.java.UDF8, java.io.Serializable {
  static final double SMALL = 1e-20;
  static final int LANES = 352;  // of a block; rows of a power of two would compete for the same lines of the cache
  static final int WIDE = 16;  // knots of a band up to which bends cost less than a look-up

  static double[] numbers(Object o) {
    scala.collection.Seq s = (scala.collection.Seq) o;
    double[] out = new double[s.size()];
    scala.collection.Iterator it = s.iterator();
    for (int i = 0; i < out.length; i++) out[i] = ((Number) it.next()).doubleValue();
    return out;
  }

  static String[] texts(Object o) {
    scala.collection.Seq s = (scala.collection.Seq) o;
    String[] out = new String[s.size()];
    scala.collection.Iterator it = s.iterator();
    for (int i = 0; i < out.length; i++) { Object x = it.next(); out[i] = x == null ? null : x.toString(); }
    return out;
  }

  static double median(double[] x) {
    double[] y = (double[]) x.clone();
    java.util.Arrays.sort(y);
    int n = y.length;
    return n % 2 == 1 ? y[n / 2] : (y[n / 2 - 1] + y[n / 2]) / 2;
  }

  /** (c0, c1, c2)[l] of the symmetric system with rows (u, v, z | right side) by elimination with pivots; false, and they stay, if singular. */
  static boolean solved(double u0, double u1, double u2, double u3, double v1, double v2, double v3, double z2, double z3, double[] c0, double[] c1, double[] c2, int l) {
    double v0 = u1, z0 = u2, z1 = v2, x;
    int p = Math.abs(v0) > Math.abs(u0) ? 1 : 0;
    if (Math.abs(z0) > Math.abs(p == 1 ? v0 : u0)) {
      x = u0; u0 = z0; z0 = x; x = u1; u1 = z1; z1 = x; x = u2; u2 = z2; z2 = x; x = u3; u3 = z3; z3 = x;
    } else if (p == 1) {
      x = u0; u0 = v0; v0 = x; x = u1; u1 = v1; v1 = x; x = u2; u2 = v2; v2 = x; x = u3; u3 = v3; v3 = x;
    }
    if (u0 == 0) return false;
    double q = v0 / u0;
    v1 -= q * u1; v2 -= q * u2; v3 -= q * u3;
    q = z0 / u0;
    z1 -= q * u1; z2 -= q * u2; z3 -= q * u3;
    if (Math.abs(z1) > Math.abs(v1)) { x = v1; v1 = z1; z1 = x; x = v2; v2 = z2; z2 = x; x = v3; v3 = z3; z3 = x; }
    if (v1 == 0) return false;
    q = z1 / v1;
    z2 -= q * v2; z3 -= q * v3;
    if (z2 == 0 || !(Math.abs(u0 * v1 * z2) >= SMALL)) return false;
    double e = z3 / z2, d = (v3 - v2 * e) / v1;
    c0[l] = (u3 - u1 * d - u2 * e) / u0; c1[l] = d; c2[l] = e;
    return true;
  }

  // A lane is one start of one trial.  Each loop below takes one observation, or four of one band, at all lanes, with nothing
  // but arithmetic on rows of lanes, which the JVM turns into vector instructions if there is not too much of it in one loop;
  // only the look-up of knots goes lane by lane.  Values g and slopes s come times q, the root of the weight; a step needs
  // seven sums of them, from which both its linear solution and its move follow.

  static void places(int lanes, double t, double wide, double[] freq, double[] phi, double[] x) {
    for (int l = 0; l < lanes; l++) { double v = freq[l] * t + phi[l]; x[l] = (v - Math.floor(v)) * wide; }
  }

  /** How far a place is from the knot before and, as the low bits of a double, which ``from`` lifts to 2^52, where that knot is. */
  static void knots(int lanes, double from, double[] x, double[] place) {
    for (int l = 0; l < lanes; l++) { double y = x[l], k = Math.floor(y); x[l] = y - k; place[l] = k * 4 + from; }
  }

  static void curves(int lanes, double q, double[] part, double[] place, double[] knot, double[] g, double[] s) {
    for (int l = 0; l < lanes; l++) {
      int k = (int) Double.doubleToRawLongBits(place[l]);
      double f = part[l];
      g[l] = q * (knot[k] + f * knot[k + 1]);
      s[l] = q * (knot[k + 2] + f * knot[k + 3]);
    }
  }

  static void values(int lanes, double q, double[] part, double[] place, double[] knot, double[] g) {
    for (int l = 0; l < lanes; l++) { int k = (int) Double.doubleToRawLongBits(place[l]); g[l] = q * (knot[k] + part[l] * knot[k + 1]); }
  }

  /** The same without a look-up: a line and at each inner knot k its bend, a multiple of |x - k|; here the first three. */
  static void bends(int lanes, double q, double[] gc, double[] sc, int o, double[] x, double[] g, double[] s) {
    double g0 = q * gc[o], g1 = q * gc[o + 1], g2 = q * gc[o + 2], g3 = q * gc[o + 3], g4 = q * gc[o + 4];
    double s0 = q * sc[o], s1 = q * sc[o + 1], s2 = q * sc[o + 2], s3 = q * sc[o + 3], s4 = q * sc[o + 4];
    for (int l = 0; l < lanes; l++) {
      double y = x[l], a = Math.abs(y - 1), b = Math.abs(y - 2), c = Math.abs(y - 3);
      g[l] = Math.fma(g4, c, Math.fma(g3, b, Math.fma(g2, a, Math.fma(g1, y, g0))));
      s[l] = Math.fma(s4, c, Math.fma(s3, b, Math.fma(s2, a, Math.fma(s1, y, s0))));
    }
  }

  /** Four more, from the knot k. */
  static void bendsMore(int lanes, double q, double k, double[] gc, double[] sc, int o, double[] x, double[] g, double[] s) {
    double g1 = q * gc[o], g2 = q * gc[o + 1], g3 = q * gc[o + 2], g4 = q * gc[o + 3], s1 = q * sc[o], s2 = q * sc[o + 1], s3 = q * sc[o + 2], s4 = q * sc[o + 3];
    double k2 = k + 1, k3 = k + 2, k4 = k + 3;
    for (int l = 0; l < lanes; l++) {
      double y = x[l], a = Math.abs(y - k), b = Math.abs(y - k2), c = Math.abs(y - k3), d = Math.abs(y - k4);
      g[l] = Math.fma(g4, d, Math.fma(g3, c, Math.fma(g2, b, Math.fma(g1, a, g[l]))));
      s[l] = Math.fma(s4, d, Math.fma(s3, c, Math.fma(s2, b, Math.fma(s1, a, s[l]))));
    }
  }

  static void bends(int lanes, double q, double[] gc, int o, double[] x, double[] g) {
    double g0 = q * gc[o], g1 = q * gc[o + 1], g2 = q * gc[o + 2], g3 = q * gc[o + 3], g4 = q * gc[o + 4];
    for (int l = 0; l < lanes; l++) {
      double y = x[l];
      g[l] = Math.fma(g4, Math.abs(y - 3), Math.fma(g3, Math.abs(y - 2), Math.fma(g2, Math.abs(y - 1), Math.fma(g1, y, g0))));
    }
  }

  static void bendsMore(int lanes, double q, double k, double[] gc, int o, double[] x, double[] g) {
    double g1 = q * gc[o], g2 = q * gc[o + 1], g3 = q * gc[o + 2], g4 = q * gc[o + 3], k2 = k + 1, k3 = k + 2, k4 = k + 3;
    for (int l = 0; l < lanes; l++) {
      double y = x[l];
      g[l] = Math.fma(g4, Math.abs(y - k4), Math.fma(g3, Math.abs(y - k3), Math.fma(g2, Math.abs(y - k2), Math.fma(g1, Math.abs(y - k), g[l]))));
    }
  }

  /** Adds four observations of one band, times what ``by`` has from the i-th. */
  static void firsts(int lanes, int i, double[] by, double[] a, double[] b, double[] c, double[] d, double[] sum) {
    double p = by[i], q = by[i + 1], r = by[i + 2], s = by[i + 3];
    for (int l = 0; l < lanes; l++) sum[l] += Math.fma(p, a[l], q * b[l]) + Math.fma(r, c[l], s * d[l]);
  }

  static void seconds(int lanes, double[] a, double[] b, double[] c, double[] d, double[] sum) {
    for (int l = 0; l < lanes; l++) { double e = a[l], f = b[l], g = c[l], h = d[l]; sum[l] += Math.fma(e, e, f * f) + Math.fma(g, g, h * h); }
  }

  static void mixed(int lanes, double[] a, double[] b, double[] e, double[] f, double[] sum) {
    for (int l = 0; l < lanes; l++) sum[l] += Math.fma(a[l], e[l], b[l] * f[l]);
  }

  static void squares(int lanes, double q, double m, double[] base, double[] amp, double[] g, double[] sum) {
    for (int l = 0; l < lanes; l++) { double x = m - q * base[l] - amp[l] * g[l]; sum[l] += x * x; }
  }

  static void less(int lanes, double[] a, double[] b, double[] sum) { for (int l = 0; l < lanes; l++) sum[l] -= a[l] * b[l]; }

  static void more(int lanes, double f, double[] a, double[] sum) { for (int l = 0; l < lanes; l++) sum[l] += f * a[l]; }

  static void bases(int lanes, double d, double[] beta, double[] c0, double[] c1, double[] base) { for (int l = 0; l < lanes; l++) base[l] = beta[l] + c0[l] + c1[l] * d; }

  static void offsets(int lanes, double sm, double under, double[] amp, double[] sum, double[] mu) {
    for (int l = 0; l < lanes; l++) mu[l] = (sm - amp[l] * sum[l]) / under;
  }

  /** What one call works on: observations (but for a walk by band, less its ``mean`` and in fours), then rows of lanes (c: coefficients, the amplitude last; beta: constants by band). */
  transient int n, bands, wide, each, found, step;
  transient double sign, s0, s1, s2, bestRss, bestPhi;
  transient boolean dusty;
  transient int[] band, off;
  transient boolean[] live, real;
  transient double[] t, mag, w, q, m, d, wd, dust, mean, from, sw, sm, knot, gc, sc, freqs, phi, part, place, gg, gs, ss, gm, vm, one, two, sy, sdy, rest, best, none;
  transient double[][] g, s, c, beta, base, gb, sb;

  static void clear(double[] a, int lanes) { java.util.Arrays.fill(a, 0, lanes, 0.0); }

  void rows(int lanes, int width) {
    live = new boolean[lanes];
    freqs = new double[lanes]; phi = new double[lanes]; part = new double[lanes]; place = new double[lanes]; rest = new double[lanes];
    gg = new double[lanes]; gs = new double[lanes]; ss = new double[lanes]; gm = new double[lanes]; vm = new double[lanes];
    one = new double[lanes]; two = new double[lanes]; sy = new double[lanes]; sdy = new double[lanes];
    none = new double[lanes]; g = new double[4][lanes]; s = new double[4][lanes]; c = new double[width][lanes]; beta = new double[bands][lanes];
    gb = new double[bands][lanes]; sb = new double[bands][lanes]; base = dusty ? new double[bands][lanes] : c;
  }

  /** Lanes of ``now`` trials from the k-th, with starts at equal distances; offsets are 0 before ``mean`` is taken off. */
  void begin(double[] freq, int k, int now, double[] table, int at) {
    int lanes = now * each;
    for (int l = 0; l < lanes; l++) {
      double f = freq[k + l / each], p = 1 / f;
      freqs[l] = f;
      phi[l] = (double) (l % each) / each;
      live[l] = true;
      if (dusty) for (int b = 0, i = at; b < bands; b++, i += 3) beta[b][l] = table[i] + table[i + 1] * p + table[i + 2] * (p * p);
    }
    for (int i = 0; i < c.length; i++) clear(c[i], lanes);
    if (dusty) {
      clear(sy, lanes); clear(sdy, lanes);
      for (int b = 0; b < bands; b++) for (int l = 0; l < lanes; l++) { double y = sm[b] - beta[b][l] * sw[b]; sy[l] += y; sdy[l] += y * dust[b]; }
      java.util.Arrays.fill(c[0], 0, lanes, -mean[0]);
      level(lanes);
      return;
    }
    for (int b = 0; b < bands; b++) java.util.Arrays.fill(c[b], 0, lanes, -mean[b]);
    java.util.Arrays.fill(c[bands], 0, lanes, 1.0);
  }

  void look(int lanes, int i, double[] g, double[] s) {
    places(lanes, t[i], wide, freqs, phi, part);
    if (gc == null) {
      knots(lanes, from[i], part, place);
      curves(lanes, q[i], part, place, knot, g, s);
      return;
    }
    int o = band[i] * step;
    bends(lanes, q[i], gc, sc, o, part, g, s);
    for (int k = 4; k < wide; k += 4) bendsMore(lanes, q[i], k, gc, sc, o + k + 1, part, g, s);
  }

  void look(int lanes, int i, double[] g) {
    places(lanes, t[i], wide, freqs, phi, part);
    if (gc == null) {
      knots(lanes, from[i], part, place);
      values(lanes, q[i], part, place, knot, g);
      return;
    }
    int o = band[i] * step;
    bends(lanes, q[i], gc, o, part, g);
    for (int k = 4; k < wide; k += 4) bendsMore(lanes, q[i], k, gc, o + k + 1, part, g);
  }

  void add(int lanes) {
    for (int b = 0; b < bands; b++) { clear(gb[b], lanes); clear(sb[b], lanes); }
    clear(gg, lanes); clear(gs, lanes); clear(ss, lanes); clear(gm, lanes); clear(vm, lanes);
    for (int i = 0; i < n; i += 4) {
      int b = band[i], many = 1;
      look(lanes, i, g[0], s[0]);
      while (many < 4 && real[i + many]) { look(lanes, i + many, g[many], s[many]); many++; }
      double[] g2 = many > 1 ? g[1] : none, g3 = many > 2 ? g[2] : none, g4 = many > 3 ? g[3] : none;
      double[] v2 = many > 1 ? s[1] : none, v3 = many > 2 ? s[2] : none, v4 = many > 3 ? s[3] : none;
      firsts(lanes, i, q, g[0], g2, g3, g4, gb[b]);
      firsts(lanes, i, m, g[0], g2, g3, g4, gm);
      firsts(lanes, i, q, s[0], v2, v3, v4, sb[b]);
      firsts(lanes, i, m, s[0], v2, v3, v4, vm);
      seconds(lanes, g[0], g2, g3, g4, gg);
      seconds(lanes, s[0], v2, v3, v4, ss);
      mixed(lanes, g[0], g2, s[0], v2, gs);
      if (many > 2) mixed(lanes, g3, g4, v3, v4, gs);
    }
  }

  void linear(int lanes) {
    clear(one, lanes); clear(two, lanes);
    for (int b = 0; b < bands; b++) { more(lanes, 1, gb[b], one); more(lanes, dust[b], gb[b], two); less(lanes, beta[b], gb[b], gm); }
    for (int l = 0; l < lanes; l++) live[l] = live[l] && solved(s0, s1, one[l], sy[l], s2, two[l], sdy[l], gg[l], gm[l], c[0], c[1], c[2], l);
    level(lanes);
  }

  void level(int lanes) { for (int b = 0; b < bands; b++) bases(lanes, dust[b], beta[b], c[0], c[1], base[b]); }

  void plain(int lanes) {
    double[] amp = c[bands];
    for (int b = 0; b < bands; b++) { offsets(lanes, sm[b], sw[b] > 0 ? sw[b] : 1, amp, gb[b], c[b]); less(lanes, c[b], gb[b], gm); }
    for (int l = 0; l < lanes; l++) if (gg[l] > SMALL) amp[l] = gm[l] / gg[l];
  }

  void turn(int lanes) {
    double[] amp = c[c.length - 1];
    for (int b = 0; b < bands; b++) less(lanes, base[b], sb[b], vm);
    for (int l = 0; l < lanes; l++) {
      double a = amp[l], down = a * a * ss[l];
      if (live[l] && Math.abs(down) > SMALL) { double x = phi[l] + sign * (a * (vm[l] - a * gs[l])) / down; phi[l] = x - Math.floor(x); }
    }
  }

  void finish(int lanes) {
    clear(rest, lanes);
    for (int i = 0; i < n; i++) if (real[i]) { look(lanes, i, g[0]); squares(lanes, q[i], m[i], base[band[i]], c[c.length - 1], g[0], rest); }
  }

  /** Takes the least of each trial's lanes. */
  void pick(int k, int now, double[] rss) {
    for (int j = 0; j < now; j++) {
      int l = j * each;
      for (int r = 1; r < each; r++) if (better(rest[j * each + r], rest[l])) l = j * each + r;
      double x = rest[l];
      // one start without a number voids the trial
      rss[k + j] = Double.isNaN(x) || Double.isInfinite(x) ? Double.POSITIVE_INFINITY : x;
      if (rss[k + j] < bestRss) { bestRss = rss[k + j]; bestPhi = phi[l]; found = k + j; for (int i = 0; i < c.length; i++) best[i] = c[i][l]; }
    }
  }

  static void curves(int n, double[] turn, int[] off, double phi, int wide, double[] gv, double[] sv, double[] g, double[] s) {
    for (int i = 0; i < n; i++) {
      double x = turn[i] + phi;
      x = (x - Math.floor(x)) * wide;
      int k = (int) x;
      double f = x - k;
      k += off[i];
      g[i] = gv[k] + f * (gv[k + 1] - gv[k]);
      s[i] = sv[k] + f * (sv[k + 1] - sv[k]);
    }
  }

  /** The dusty trials of a warm walk, which wait for each other: one lane, whose phase stays, with loops over its observations. */
  void walk(double[] freq, int newton, double[] table, int at, double[] gv, double[] sv, double[] rss) {
    double[] turn = new double[n], y = new double[n], g = new double[n], s = new double[n];
    for (int k = 0; k < rss.length; k++) {
      double p = 1 / freq[k], sumY = 0, sumDy = 0, angle = phi[0], square = 0;
      for (int i = 0; i < n; i++) {
        turn[i] = freq[k] * t[i];
        int b = at + 3 * band[i];
        y[i] = mag[i] - (table[b] + table[b + 1] * p + table[b + 2] * (p * p));
        sumY += w[i] * y[i];
        sumDy += wd[i] * y[i];
      }
      for (int i = 0; i < 3; i++) c[i][0] = 0;
      for (int step = 0; step < newton; step++) {
        curves(n, turn, off, angle, wide, gv, sv, g, s);
        double g1 = 0, g2 = 0, g3 = 0, g4 = 0, down = 0, up = 0;
        for (int i = 0; i < n; i++) { double x = w[i] * g[i]; g1 += x; g2 += x * d[i]; g3 += x * g[i]; g4 += x * y[i]; }
        if (!solved(s0, s1, g1, sumY, s2, g2, sumDy, g3, g4, c[0], c[1], c[2], 0)) break;
        double c0 = c[0][0], c1 = c[1][0], c2 = c[2][0];
        for (int i = 0; i < n; i++) { double slope = c2 * s[i], x = w[i] * slope; down += x * slope; up += x * (y[i] - c0 - c1 * d[i] - c2 * g[i]); }
        if (Math.abs(down) > SMALL) { angle += sign * up / down; angle -= Math.floor(angle); }
      }
      curves(n, turn, off, angle, wide, gv, sv, g, s);
      double c0 = c[0][0], c1 = c[1][0], c2 = c[2][0];
      for (int i = 0; i < n; i++) { double x = y[i] - c0 - c1 * d[i] - c2 * g[i]; square += w[i] * x * x; }
      phi[0] = angle;
      rest[0] = square;
      pick(k, 1, rss);
    }
  }

  /** Rows of a table one place wider and a last place more: the circle closed. */
  static double[] closed(double[] table, int from, int bands, int wide) {
    double[] out = new double[bands * (wide + 1) + 1];
    for (int b = 0; b < bands; b++) for (int i = 0; i <= wide; i++) out[b * (wide + 1) + i] = table[from + b * wide + i % wide];
    return out;
  }

  /** Coefficients of ``bends`` by band, ``step`` of them: a line's two, then half the change of slope at each inner knot. */
  static double[] bent(double[] closed, int bands, int wide, int step) {
    double[] out = new double[bands * step];
    for (int b = 0, o = 0, i = 0; b < bands; b++, o += step, i += wide + 1) {
      out[o] = closed[i];
      out[o + 1] = (closed[i + 1] - closed[i] + closed[i + wide] - closed[i + wide - 1]) / 2;
      for (int k = 1; k < wide; k++) {
        double c = (closed[i + k + 1] - 2 * closed[i + k] + closed[i + k - 1]) / 2;
        out[o + 1 + k] = c;
        out[o] -= c * k;
      }
    }
    return out;
  }

  void alone(int n, double[] t, double[] mag, double[] w, int[] band, int[] off) {
    this.n = n; this.t = t; this.mag = mag; this.w = w; this.band = band; this.off = off;
    d = new double[n]; wd = new double[n];
    for (int i = 0; i < n; i++) { d[i] = dust[band[i]]; wd[i] = w[i] * d[i]; s0 += w[i]; s1 += wd[i]; s2 += wd[i] * d[i]; sw[band[i]] += w[i]; }
  }

  /** By band, filled up to fours; magnitudes less their band's mean, in the dusty mode that of all, so that little cancels in sums. */
  void grouped(int many, double[] times, double[] mags, double[] weights, int[] which, double[] gv, double[] sv) {
    int[] count = new int[bands];
    double all = 0;
    for (int i = 0; i < many; i++) { int b = which[i]; double x = weights[i]; count[b]++; sw[b] += x; mean[b] += x * mags[i]; s0 += x; all += x * mags[i]; }
    for (int b = 0; b < bands; b++) {
      mean[b] = dusty ? s0 > 0 ? all / s0 : 0 : sw[b] > 0 ? mean[b] / sw[b] : 0;
      s1 += sw[b] * dust[b]; s2 += sw[b] * dust[b] * dust[b];
      n += (count[b] + 3) / 4 * 4;
    }
    t = new double[n]; q = new double[n]; m = new double[n]; from = new double[n]; band = new int[n]; real = new boolean[n];
    for (int b = 0, k = 0; b < bands; b++, k = (k + 3) / 4 * 4) for (int i = 0; i < many; i++) if (which[i] == b) {
      double x = mags[i] - mean[b];
      t[k] = times[i]; q[k] = Math.sqrt(weights[i]); m[k] = q[k] * x; from[k] = 4503599627370496.0 + 4 * b * (wide + 1); band[k] = b; real[k] = true;
      sm[b] += weights[i] * x;
      k++;
    }
    if (wide <= WIDE) {
      step = 5 + wide / 4 * 4;
      gc = bent(gv, bands, wide, step); sc = bent(sv, bands, wide, step);
      return;
    }
    knot = new double[4 * gv.length];
    for (int i = 0; i + 1 < gv.length; i++) { knot[4 * i] = gv[i]; knot[4 * i + 1] = gv[i + 1] - gv[i]; knot[4 * i + 2] = sv[i]; knot[4 * i + 3] = sv[i + 1] - sv[i]; }
  }

  static boolean better(double x, double best) { return x < best || (Double.isNaN(x) && !Double.isNaN(best)); }

  public Object call(Object times, Object mags, Object errors, Object bandNames, Object templateBands, Object templateTable, Object range, Object settings) {
    double[] t0 = numbers(times), m0 = numbers(mags), e0 = numbers(errors), table = numbers(templateTable), limits = numbers(range), how = numbers(settings);
    String[] names = texts(bandNames), known = texts(templateBands);
    double dphi = how[0];
    int least = (int) how[1], newton = (int) how[2], starts = (int) how[3];
    boolean errorsCount = how[5] != 0, dusty = table[0] != 0, warm = how[4] != 0 && dusty;
    double sign = how[6];
    int wide = (int) table[1], bands = known.length, n = 0;
    int[] at = new int[t0.length];
    for (int i = 0; i < t0.length; i++) {
      at[i] = -1;
      for (int b = 0; b < bands; b++) if (known[b].equals(names[i])) at[i] = b;
      if (at[i] >= 0) n++;
    }
    if (n < least || n == 0) return new double[0][];
    double[] t = new double[n], mag = new double[n], w = new double[n], err = new double[n];
    int[] band = new int[n], off = new int[n];
    double first = Double.POSITIVE_INFINITY, last = Double.NEGATIVE_INFINITY;
    int good = 0;
    for (int i = 0, k = 0; i < t0.length; i++) if (at[i] >= 0) {
      t[k] = t0[i]; mag[k] = m0[i]; err[k] = e0[i]; band[k] = at[i]; off[k] = at[i] * (wide + 1);
      first = Math.min(first, t[k]); last = Math.max(last, t[k]);
      if (err[k] > 0) good++;
      k++;
    }
    double usual = 1;
    if (good > 0 && good < n) {
      double[] some = new double[good];
      for (int i = 0, k = 0; i < n; i++) if (err[i] > 0) some[k++] = err[i];
      usual = median(some);
    }
    for (int i = 0; i < n; i++) { double e = err[i] > 0 ? err[i] : usual; w[i] = errorsCount ? 1 / (e * e) : 1; }
    double span = last - first;
    if (!(span > 0)) return new double[0][];
    int all = (int) Math.max(1, (long) ((1 / limits[0] - 2 / span) / (dphi / span))), nf = 0;
    double[] freq = new double[all];
    for (int i = 0; i < all; i++) { double f = 2 / span + i * (dphi / span); if (Double.isNaN(limits[1]) || 1 / f <= limits[1]) freq[nf++] = f; }
    if (nf == 0) return new double[0][];

    double[] gv = closed(table, 2, bands, wide), sv = closed(table, 2 + bands * wide, bands, wide);
    int dust = 2 + 2 * bands * wide, width = dusty ? 3 : bands + 1, each = warm ? 1 : starts;
    int many = warm ? 1 : Math.max(1, Math.min(nf, LANES / each));
    @NAME@ x = new @NAME@();
    x.bands = bands; x.wide = wide; x.each = each; x.dusty = dusty; x.sign = sign; x.best = new double[width]; x.found = -1; x.bestRss = Double.POSITIVE_INFINITY;
    x.dust = new double[bands]; x.mean = new double[bands]; x.sw = new double[bands]; x.sm = new double[bands];
    if (dusty) for (int b = 0; b < bands; b++) x.dust[b] = table[dust + b];
    if (warm) x.alone(n, t, mag, w, band, off); else x.grouped(n, t, mag, w, band, gv, sv);
    x.rows(many * each, width);
    double[] rss = new double[nf], best = x.best;
    if (warm) x.walk(freq, newton, table, dust + bands, gv, sv, rss);
    else for (int k = 0; k < nf; k += many) {
      int now = Math.min(many, nf - k), lanes = now * each;
      x.begin(freq, k, now, table, dust + bands);
      for (int step = 0; step < newton; step++) {
        x.add(lanes);
        if (dusty) x.linear(lanes); else x.plain(lanes);
        x.turn(lanes);
      }
      x.finish(lanes);
      x.pick(k, now, rss);
    }
    int found = x.found;
    if (found < 0) return new double[0][];
    double[] out = new double[8 + (dusty ? 0 : bands)];
    out[0] = 1 / freq[found]; out[1] = x.bestPhi; out[2] = x.bestRss; out[3] = median(rss); out[4] = n; out[5] = best[width - 1];
    out[6] = dusty ? best[0] + x.mean[0] : Double.NaN; out[7] = dusty ? best[1] : Double.NaN;
    if (!dusty) for (int b = 0; b < bands; b++) out[8 + b] = x.sw[b] > 0 ? best[b] + x.mean[b] : Double.NaN;
    return new double[][] {out};
  }
}
"""
NAME = "Fit" + hashlib.sha256(SOURCE.encode()).hexdigest()[:12]
_known: dict[tuple, str] = {}


def function(spark: SparkSession) -> str:
    """The name of the session's function (times, magnitudes, errors, bands, bands and ``table`` of a template, range of periods, settings) -> rows."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    key = (spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID())
    if key not in _known:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE.replace("@NAME@", NAME))
        made = compiler.getBytecodes()
        jar = os.path.join(tempfile.mkdtemp(prefix="starfold-"), f"{NAME}.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for name in made.keySet():
                z.writestr(name.replace(".", "/") + ".class", bytes(made.get(name)))
        spark.sql(f"ADD JAR '{jar}'")
        none = lambda kind: gateway.new_array(kind, 0)
        one = compiler.getClassLoader().loadClass(f"starfold.{NAME}").getDeclaredConstructor(none(jvm.java.lang.Class)).newInstance(none(jvm.java.lang.Object))
        spark._jsparkSession.udf().register(NAME, one, jvm.org.apache.spark.sql.types.DataType.fromDDL("array<array<double>>"))
        _known[key] = NAME
    return _known[key]


def frame(spark: SparkSession, templates: list[Template], blocks: int) -> DataFrame:
    """``block, template_id, _bands, _table`` of every template: kind, width, values, slopes, and of a dusty one dust and coefficients by band."""
    rows = []
    for i, t in enumerate(templates):
        dusty = t.dust is not None
        table = [float(dusty), float(t.gamma.shape[1]), *t.gamma.ravel().tolist(), *t.slopes().ravel().tolist(), *([*map(float, t.dust), *map(float, t.betas.ravel())] if dusty else [])]
        rows.append((i % blocks, t.name, list(t.bands), table))
    return spark.createDataFrame(rows, "block int, template_id string, _bands array<string>, _table array<double>")
