"""Scalar functions as column expressions."""

from .scalars import (
    atoi,
    bit_length,
    ceil_div,
    cell,
    elapsed_ns,
    elapsed_us,
    http_response,
    is_sorted_violation,
    kth_bit,
    perf_line,
    seconds,
)

__all__ = ["atoi", "bit_length", "ceil_div", "cell", "elapsed_ns", "elapsed_us", "http_response", "is_sorted_violation", "kth_bit", "perf_line", "seconds"]
