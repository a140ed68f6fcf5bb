import random
import time

import pytest
from pyspark.sql import functions as F

from loomstone.functions import arithmetic, binary, hashing, permutations, scalar, schedules
from loomstone.operators import headers
from loomstone.operators.quantise import unpack
from loomstone.plans import coding
from loomstone.plans.coding import AdaptiveCounts
from loomstone.sources import containers, frames
from loomstone.sources.tables import append_trailer, split_trailer


def test_splitmix():
    assert [f"{int(x):016x}" for x in hashing.splitmix([0, 1, 255])] == ["e220a8397b1dcdaf", "910a2dec89025cc1", "338c507146283fb4"]


@pytest.mark.parametrize(
    ("block", "key", "vote"),
    [
        (b"", "a706dd2f4d197e6f", "0000000000000000"),
        (b"ab", "c9e8c161f6c33e3f", "404ca84820601d11"),
        (b"abc", "b68c99feb9d07c4f", "6195f1021d1ff292"),
        (b"abc" * 20, "c0462e2ae834d70a", "e381f7225f1fb396"),
        (b"    L/\xdf\x99N\nhello world, hello", "d25ed60c13943336", "8bb97ff346902008"),
    ],
)
def test_block_features(block, key, vote):
    for many in ([block], [b"x" * 40, block, b"", block * 3]):  # alone, and among others
        at = many.index(block)
        assert (f"{int(hashing.structural_keys(many)[at]):016x}", f"{int(hashing.simhashes(many)[at]):016x}") == (key, vote)


def test_range_coder():
    uniform = lambda i, before: range(257)
    fixed = arithmetic.masses([0.5, 0.25, 0.25, 0])
    assert fixed == [0, 500000, 750000, 1000000, 1000001]
    coded = [arithmetic.encode(x, uniform).hex() for x in (b"", b"abc", bytes(4))]
    assert coded == ["40", "61626340", "0000000040"]
    assert arithmetic.encode([0, 1, 2, 0, 0], lambda i, before: fixed).hex() == "58"
    for seed in range(20):
        draw = random.Random(seed)
        symbols = [min(255, int(draw.expovariate(0.05))) for _ in range(draw.randrange(300))]
        assert arithmetic.decode(arithmetic.encode(symbols, AdaptiveCounts()), len(symbols), AdaptiveCounts()) == symbols


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_lehmer(spark):
    ints = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    for order, code in (([3, 0, 2, 1, 4], [3, 0, 1, 0, 0]), ([0, 1, 2], [0, 0, 0]), ([2, 1, 0], [2, 1, 0]), ([], [])):
        assert one(spark, permutations.lehmer(ints(order))) == code
        assert one(spark, permutations.unlehmer(ints(code))) == order
    for wrong in (permutations.lehmer(ints([0, 0])), permutations.unlehmer(ints([2, 0]))):
        with pytest.raises(Exception, match="not a"):
            one(spark, wrong)


def test_bytes_and_bits(spark):
    for v in (0, 1, 255, 256, 576278322, 2**40 + 5):
        assert one(spark, binary.from_le(binary.to_le(F.lit(v).cast("long"), 8), 1, 8)) == v
        assert one(spark, binary.from_uvarint(scalar.uvarint(F.lit(v).cast("long")))) == v
    assert one(spark, F.hex(binary.pack_bits(F.lit("101")))) == "A0"
    assert one(spark, binary.unpack_bits(binary.pack_bits(F.lit("1011001110")), F.lit(10))) == "1011001110"
    assert one(spark, binary.unpack_bits(binary.pack_bits(F.lit("")), F.lit(0))) == ""


def test_schedule_refuses_what_it_cannot_read(spark):
    assert [tuple(x) for x in one(spark, schedules.parsed_schedule(F.lit(" 30:2,,5:1 ")))] == [(5, 1), (30, 2)]
    for wrong in ("5", "5:0", "a:1", "-3:2"):
        with pytest.raises(Exception, match="pos:steps"):
            one(spark, schedules.parsed_schedule(F.lit(wrong)))


HEADER = [
    ("revision>", "01"), ("id>1000", "05e807"), ("timestamp>06123:45296", "06067b00f0b00000"), ("contributor>", "02"), ("username>Ann", "0700"), ("id>7", "0c00"), ("/contributor>", "03"),
    ("revision>", "01"), ("id>1003", "0b06"), ("contributor>", "02"), ("username>Ann", "0700"), ("id>7", "0c00"), ("/contributor>", "03"),
    ("revision>", "01"), ("id>1001", "0b05"), ("contributor>", "02"), ("ip>10.0.0.255", "090a0000ff"), ("/contributor>", "03"), (">-5", "040b"), ("minor/", "0a06006d696e6f722f"),
]


def test_header_records(spark):
    odd = ["id>007", "timestamp>06012:5", "ip>1.2.3.256", "ip>01.2.3.4", ">-0", "username>" + "n" * 300, "username>Bob", "id>9", "", "revision>", "minor/ é"]
    rows = [(0, k, line) for k, (line, _) in enumerate(HEADER)] + [(1, k, line) for k, line in enumerate(odd)]
    lines = spark.createDataFrame(rows, "doc long, line_no long, line string")
    users, ids = headers.dictionaries(lines)
    ops = headers.encoded(lines, users, ids).cache()
    assert [r.op.hex() for r in ops.where("doc = 0").orderBy("line_no").collect()] == [op for _, op in HEADER]
    assert sorted((r.doc, r.line_no, r.line) for r in headers.expanded(ops, users, ids).collect()) == rows
    side = {r.doc: r.side.hex() for r in headers.side_dictionary(lines, users, ids).collect()}
    assert side == {0: "4d334832" + "01" + "03416e6e" + "01" + "07", 1: "4d3348320000"}
    with pytest.raises(Exception, match="too long"):
        headers.encoded(spark.createDataFrame([(0, 0, "x" * 70_000)], lines.schema), users, ids).collect()


def test_containers(spark):
    b = lambda x: F.lit(x).cast("binary")
    whole = containers.build(b("body"), b("head"), b("lg"))
    assert bytes(one(spark, whole)) == b"10body4\n2\nheadlg"
    assert [bytes(x) for x in one(spark, containers.parse(whole))] == [b"body", b"head", b"lg"]
    assert one(spark, containers.parse(b("99x"))) is None and one(spark, containers.parse(b("no digits"))) is None
    assert not one(spark, containers.sealed_or_raw(b("7up"), b("head"), b("lg"))).sealed
    sealed = containers.seal(b("in"), b("main part"), b("coda"))
    assert [bytes(x) for x in one(spark, containers.peel(sealed))] == [b"in", b"main part", b"coda"]
    with pytest.raises(Exception, match="version"):
        one(spark, containers.unseal(append_trailer(b("x"), binary.to_le(F.lit(9), 8), containers.META)))


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, F.hex(scalar.uvarint(lit(x).cast("long")))).lower() for x in (0, 127, 128, 300, 16384, 576278322)] == ["00", "7f", "8001", "ac02", "808001", "b29ee59202"]
    assert [one(spark, scalar.zigzag(lit(x))) for x in (0, 1, -1, 2, -2, 63, -64)] == [0, 2, 3, 4, 5, 126, 129]
    assert [one(spark, scalar.unzigzag(lit(x))) for x in (0, 2, 3, 4, 5, 126, 129, 1)] == [0, 1, -1, 2, -2, 63, -64, 0]
    assert [one(spark, scalar.upper_median(F.array(*map(lit, x)))) for x in ([1, 2, 3, 4], [5], [0, 0])] == [3, 5, 1024]
    assert [one(spark, scalar.ipv4(lit(x))) for x in ("10.0.0.255", "256.1.1.1", "1.2.3", "a.b.c.d")] == [10 * 2**24 + 255, None, None, None]
    rates = [one(spark, scalar.half_life_rate(lit(p), 8e-5, 50e6, 4e-5)) for p in (0, 50e6, 100e6)]
    assert rates == pytest.approx([8e-5, 4e-5, 4e-5])


@pytest.mark.parametrize(("packed", "bits", "codes"), [("e4", 2, [0, 1, 2, 3]), ("88c6fa", 3, list(range(8))), ("2143", 4, [1, 2, 3, 4]), ("", 4, [])])
def test_unpack(spark, packed, bits, codes):
    assert one(spark, unpack(F.unhex(F.lit(packed)), bits, F.lit(len(codes)))) == codes


def test_trailers_and_frames(spark):
    body = F.lit(b"body").cast("binary")
    sealed = append_trailer(body, F.lit(b"tail"), "LOOMTRLR")
    assert one(spark, append_trailer(sealed, F.lit(b"x"), "LOOMTRLR")) == one(spark, sealed)
    parts = one(spark, split_trailer(sealed, "LOOMTRLR"))
    assert (bytes(parts.body), bytes(parts.trailer)) == (b"body", b"tail")
    assert bytes(one(spark, split_trailer(body, "LOOMTRLR")).body) == b"body"
    framed = b"".join(len(x).to_bytes(8, "little") + x for x in (b"one", b"", b"three"))
    assert frames.split_frames(framed) == [b"one", b"", b"three"]
    for cut in (framed[:-1], framed + b"1234"):
        with pytest.raises(ValueError, match="truncated"):
            frames.split_frames(cut)
    with pytest.raises(Exception, match="longer"):
        one(spark, split_trailer(F.lit(b"bodyLOOMTRLR" + (99).to_bytes(8, "little")), "LOOMTRLR"))


def test_segments_in_step():
    """Segments coded in step have the payloads of segments coded one by one, and are decoded again, whatever their lengths."""
    draw = random.Random(11)
    alphabets = [bytes(range(256)), b"etaoin shrdlu", b"\x00", b"\xff\x00", b"\x7f\x80"]
    segments = [bytes(draw.choices(draw.choice(alphabets), k=draw.choice([0, 1, 2, 7, 60, 512]))) for _ in range(120)] + [b"", b"a" * 5000]
    payloads = coding.encode_by_counts(segments)
    assert payloads == [arithmetic.encode(x, AdaptiveCounts()) for x in segments]
    assert coding.decode_by_counts(payloads, [len(x) for x in segments]) == segments
    assert coding.encode_by_counts([]) == coding.decode_by_counts([], []) == []
    long = [bytes(draw.choices(b"abc", k=70_000)) for _ in range(2)]  # few and long: each by itself
    assert coding.decode_by_counts(coding.encode_by_counts(long[:1]), [70_000]) == long[:1]
    many = [bytes(draw.choices(b"etaoin shrdlu", k=512)) for _ in range(600)]
    began = time.process_time()
    coding.encode_by_counts(many)
    spent = time.process_time() - began
    for x in many[:60]:
        arithmetic.encode(x, AdaptiveCounts())
    assert 600 * (time.process_time() - began - spent) / 60 > 3 * spent
