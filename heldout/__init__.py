"""Held-out: controlled experiments on grouped data, written as Spark jobs.

Scenes (groups) are sampled, labelled, audited, split and probed with linear
models; results come with cluster-bootstrap intervals and tests.  Every public
function takes and returns DataFrames or Columns.
"""
