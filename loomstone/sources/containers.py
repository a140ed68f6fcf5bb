"""Containers of a body, a header and a language part, and products sealed with the sizes of their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.binary import from_le, to_le
from loomstone.functions.scalar import let
from loomstone.sources.tables import append_trailer, split_trailer

#: Fixed values of the seal.
META, VERSION, SIZES = "LOOMMETA", 1, ("version", "intro", "coda", "main")


def _ascii(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def build(body: Column, header: Column, lang: Column) -> Column:
    """Digits of the tail's length, the body, and a tail of both sizes in lines of their own, header and lang (all binary)."""
    sizes = F.concat_ws("\n", F.octet_length(header).cast("string"), F.octet_length(lang).cast("string"), F.lit(""))
    tail = F.concat(sizes.cast("binary"), header, lang)
    return F.concat(F.octet_length(tail).cast("string").cast("binary"), body, tail)


def parse(content: Column) -> Column:
    """struct(body, header, lang) of a container, null if it isn't well-formed. A body that begins with a digit can't be told
    from the length before it: whoever seals has to compare."""
    digits = F.regexp_extract(_ascii(F.substring(content, F.lit(1), F.lit(20))), "^[0-9]+", 0)
    n, size = F.octet_length(content), digits.try_cast("int")
    body_size = n - F.char_length(digits) - size
    start = n - size
    sizes = F.regexp_extract(_ascii(F.substring(content, start + 1, F.lit(42))), "^([0-9]+)\n([0-9]+)\n", 0)
    header, lang = (F.split(sizes, "\n")[k].try_cast("int") for k in (0, 1))
    at = start + F.char_length(sizes) + 1
    found = F.struct(
        F.substring(content, F.char_length(digits) + 1, body_size).alias("body"), F.substring(content, at, header).alias("header"), F.substring(content, at + header, lang).alias("lang")
    )
    good = (body_size >= 0) & (sizes != "") & (at - 1 + header + lang <= n)
    return F.when(F.coalesce(good, F.lit(False)), found)


def sealed_or_raw(body: Column, header: Column, lang: Column) -> Column:
    """struct(sealed, content): the container if parsing it gives the parts back byte by byte, else the parts as they are."""
    whole = build(body, header, lang)
    back = parse(whole)
    same = back.isNotNull() & (back["body"] == body) & (back["header"] == header) & (back["lang"] == lang)
    same = F.coalesce(same, F.lit(False))
    return F.struct(same.alias("sealed"), F.when(same, whole).otherwise(F.concat(body, header, lang)).alias("content"))


def seal(intro: Column, main: Column, coda: Column) -> Column:
    """The parts in order, with their sizes in a trailer."""
    meta = F.concat(to_le(F.lit(VERSION), 8), *[to_le(F.octet_length(x), 8) for x in (intro, coda, main)])
    return append_trailer(F.concat(intro, main, coda), meta, META)


def stream_length(content: Column) -> Column:
    """The bytes of a stream without its trailer."""
    return F.octet_length(split_trailer(content, META)["body"]).cast("long")


def _sizes(meta: Column) -> Column:
    sizes = F.struct(*[from_le(meta, 8 * k + 1, 8).alias(name) for k, name in enumerate(SIZES)])
    wrong = F.raise_error(F.lit("the seal has another version")).cast("struct<version:bigint,intro:bigint,coda:bigint,main:bigint>")
    return F.when(meta.isNotNull(), F.when(from_le(meta, 1, 8) == VERSION, sizes).otherwise(wrong))


def unseal(content: Column) -> Column:
    """struct(version, intro, coda, main): sizes, of a sealed product; another version is an error, no trailer gives null."""
    return let(split_trailer(content, META)["trailer"], _sizes)


def peel(content: Column) -> Column:
    """struct(intro, main, coda) of a sealed product, cut by the sizes in its trailer, which must add up to it."""
    drift = F.raise_error(F.lit("sizes don't add up")).cast("struct<intro:binary,main:binary,coda:binary>")

    def cut(body: Column, sizes: Column) -> Column:
        a, m, c = (sizes[k].cast("int") for k in ("intro", "main", "coda"))
        parts = F.struct(F.substring(body, F.lit(1), a).alias("intro"), F.substring(body, a + 1, m).alias("main"), F.substring(body, a + m + 1, c).alias("coda"))
        return F.when(a + m + c == F.octet_length(body), parts).otherwise(drift)

    return let(split_trailer(content, META), lambda s: let(_sizes(s["trailer"]), lambda sizes: cut(s["body"], sizes)))
