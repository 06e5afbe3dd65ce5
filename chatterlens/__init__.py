"""Audience-comment analytics as DataFrame and Structured Streaming operators.

Every operator takes DataFrames plus parameters and returns a DataFrame; none of
them collects its input. Wiring of the operators to concrete tables lives in
``plans``.
"""
