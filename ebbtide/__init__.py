"""Subscriber-churn analytics on Spark DataFrames.

Layout
------
schema      column names, types, roles and fixed business values
functions   column expressions (rounding, bins, answers, risk tiers)
sources     readers, writers, the subscriber view and the generator
operators   DataFrame -> DataFrame transforms
plans       composites: preprocessing, training, evaluation, the whole job
streaming   scoring of an event stream
catalog     named queries over the driver tables and their SQL twins
"""
