"""Bits, text to number, elapsed times and text formats. All stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes read from a request at once; the reply's buffer has one more.
REQUEST_BYTES = 4095
# fixed values: the log lines' and the reply's formats
PERF_PATTERN = r"(?m)^PERFDATA,(\d+),([^,]+),(\d+),(\d+),(\d+),([\d.]+)"
TRAVERSAL_PATTERN = r"traversal time:\s*([\d.]+) ns"
REPLY_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Length: "
REPLY_REST = "\r\nConnection: close\r\n\r\n"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kth_bit(value: Column | str, k: int | Column) -> Column:
    """Bit k of a non-negative integer, as int."""
    return F.getbit(_c(value), k if isinstance(k, Column) else F.lit(k)).cast("int")


def bit_length(value: Column | str) -> Column:
    """Bits needed for a non-negative integer; 0 for 0, null for negative numbers (which have no such length)."""
    v = _c(value)
    return F.when(v == 0, 0).when(v > 0, F.length(F.bin(v))).cast("int")


def atoi(text: Column | str) -> Column:
    """The integer a text starts with, after white space and a sign; 0 if there is none or it doesn't fit 32 bits."""
    return F.coalesce(F.regexp_extract(_c(text), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def ceil_div(a: Column, b: Column) -> Column:
    """Integer division of non-negative numbers, rounded up."""
    return F.floor((a + b - 1) / b).cast("long")


def micros(t: Column | str) -> Column:
    return F.unix_micros(_c(t).cast("timestamp"))


def elapsed_us(start: Column | str, stop: Column | str) -> Column:
    """Microseconds between two timestamps, with or without a time zone."""
    return micros(stop) - micros(start)


def elapsed_ns(start_s: Column | str, start_ns: Column | str, stop_s: Column | str, stop_ns: Column | str) -> Column:
    """Nanoseconds between two (seconds, nanoseconds) clocks, as long: timestamps have microseconds only."""
    return (_c(stop_s) - _c(start_s)).cast("long") * 1_000_000_000 + (_c(stop_ns) - _c(start_ns)).cast("long")


def seconds(ns: Column | str) -> Column:
    """Nanoseconds as seconds with six decimals, as text; empty for null."""
    n = _c(ns)
    return F.when(n.isNotNull(), F.format_string("%.6f", n / 1e9)).otherwise("")


def cell(x: Column | str, form: str = "%8.4f") -> Column:
    """A number as text of a fixed width; 'NaN' and null come as in printf of the JVM."""
    return F.format_string(form, _c(x))


def perf_line(size: Column, program: Column, threads: Column, least: Column, stack: Column, ns: Column) -> Column:
    return F.concat_ws(",", F.lit("PERFDATA"), size.cast("string"), program, threads.cast("string"), least.cast("string"), stack.cast("string"), ns.cast("string"))


def http_response(request: Column | str) -> Column:
    """The reply to a request, as binary: status 200, the bytes read, and these themselves up to the first zero byte, cut where the reply's buffer ends.

    At most 4,095 bytes are read, and header and body together are cut there too, wherever in a character that is; the stated
    length isn't adjusted.
    """
    read = F.substring(F.coalesce(_c(request), F.lit("")).cast("binary"), 1, REQUEST_BYTES)
    header = F.concat(F.lit(REPLY_HEAD), F.octet_length(read).cast("string"), F.lit(REPLY_REST)).cast("binary")
    zero = F.instr(F.hex(read), "00")  # most requests have none; two hex digits at an odd place are a byte
    at = F.array_position(F.transform(F.sequence(F.lit(1), F.octet_length(read)), lambda i: F.substring(read, i, F.lit(1))), F.lit(bytearray(1)))
    text = F.when((zero > 0) & (at > 0), F.substring(read, F.lit(1), at.cast("int") - 1)).otherwise(read)
    return F.substring(F.concat(header, text), 1, REQUEST_BYTES)


def is_sorted_violation(pos: Column | str, value: Column | str) -> Column:
    """True where a sorted permutation of 0..n-1 has another value than its place."""
    return ~_c(pos).eqNullSafe(_c(value))
