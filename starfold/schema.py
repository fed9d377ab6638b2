"""Schemas of the engine's frames, as DDL.

A light curve is a long frame, one row per observation; every operator maps such frames to frames.  Missing values are
NULL; NaN in input counts as missing.
"""

LIGHT_CURVE = "object_id long, row_id long, t double, band string, mag double, magerr double"
FLUX_CURVE = "object_id long, row_id long, t double, band string, flux double, flux_err double"
TEMPLATE = "template_id string, band string, bidx int, gamma array<double>, dust double, c0 double, p1 double, p2 double"
FIT = "object_id long, template_id string, period double, phi double, rss double, rss_median double, n_obs long, A double, mu double, ebv double, mu_band map<string,double>"
RSS_GRID = "object_id long, template_id string, k long, period double, rss double, phi double"
