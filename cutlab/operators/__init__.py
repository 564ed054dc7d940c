"""Operators on keyed time series: DataFrame in, DataFrame out, nothing collected.

A curve has one row a sample: clip, i (position), t (time), sim (score).
Segments have clip, seg_idx, start, end, label. Lists of times are arrays.
"""
