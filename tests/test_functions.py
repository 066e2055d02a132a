import hashlib

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import net, stats, text, tls
from sessionlens.plans.catalog import client_hello_bytes

CASES = [
    ("8.8.8.8", "ipv4", True), ("10.1.2.3", "ipv4", False), ("100.64.0.1", "ipv4", True), ("192.0.2.1", "ipv4", True), ("0.0.0.1", "ipv4", True), ("0.0.0.0", "ipv4", False), ("127.0.0.1", "ipv4", False), ("169.254.1.1", "ipv4", False),
    ("224.0.0.1", "ipv4", False), ("01.2.3.4", "unknown", False), ("x", "unknown", False), (None, "unknown", False), ("2001:db8::1", "ipv6", True), ("::1", "ipv6", False), ("::", "ipv6", False), ("fd00::1", "ipv6", False), ("fe80::1", "ipv6", False), ("ff02::1", "ipv6", False), ("1:2:3:4:5:6:7:8", "ipv6", True), ("1::2::3", "unknown", False),
]


def test_addresses(spark):
    ip = F.col("ip")
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "k int, ip string").select("k", net.ip_family(ip, F.lit(None).cast("string")).alias("f"), net.is_external(ip).alias("e")).orderBy("k").collect()
    assert [(r.f, r.e) for r in rows] == [(c[1], c[2]) for c in CASES]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_directions(spark):
    d = lambda a, b: one(spark, net.base_direction(F.lit(a), F.lit(b)))
    assert (d("127.0.0.1", "127.0.0.9"), d("1.1.1.1", "1.1.1.1"), d("1.1.1.1", "2.2.2.2"), d("x", "x")) == ("local", "local", "unknown", "unknown")
    e = lambda s, t: one(spark, net.direction(F.lit("unknown"), F.lit(s), F.lit(t)))
    assert (e(True, False), e(False, True), e(True, True)) == ("ingress", "egress", "unknown")


def test_text(spark):
    assert one(spark, text.rfc3339(F.lit(1_500_000_000).cast("long"))) == "1970-01-01T00:00:01.5Z"
    assert one(spark, text.rfc3339(F.lit(0).cast("long"))) == "1970-01-01T00:00:00Z"
    assert one(spark, text.pod_uid_from_cgroup(F.lit("/kubepods-pod0123abcd_0123_0123_0123_0123456789ab.slice/x"))) == "0123abcd-0123-0123-0123-0123456789ab"
    assert one(spark, text.container_id_from_cgroup(F.lit("/a/crio-ff.scope"))) == "ff"
    assert one(spark, text.sni_hash(F.lit("Example.COM"))) == "a379a6f6eeafb9a5"
    assert one(spark, text.list_hash(F.array().cast("array<string>"))) == "0" * 12
    assert [one(spark, text.close_reason(F.lit(x), "unknown")) for x in ("FIN", "", "weird")] == ["fin", "unknown", "unknown"]


def test_histograms(spark):
    counts = F.array(*[F.lit(x).cast("long") for x in (0, 10, 10, 0, 0, 0, 0)])
    p = lambda q: one(spark, stats.clamp(stats.histogram_percentile(counts, stats.PACKET_BOUNDS, q), F.lit(64), F.lit(255)))
    assert p(0.5) == pytest.approx(127) and p(0.95) == pytest.approx(242.3)
    none = F.array_repeat(F.lit(0).cast("long"), 7)
    assert one(spark, stats.histogram_percentile(none, stats.PACKET_BOUNDS, 0.5)) is None and one(spark, stats.histogram_mean(none, stats.PACKET_BOUNDS)) is None
    assert [one(spark, stats.iat_bucket(F.lit(v))) for v in (99, 100, 1000, 1001, 10**7)] == [0, 1, 1, 2, 5]
    assert one(spark, stats.safe_ratio(F.lit(10), F.lit(0))) is None and one(spark, stats.rate(F.lit(4), F.lit(2_000_000_000))) == 2


def test_client_hello():
    ciphers, ext = [0x1301, 0x1302, 0x1303, 0xC02B, 0xC02F, 0xC02C, 0xC030, 0xCCA9, 0xCCA8, 0xC013, 0xC014, 0x009C, 0x009D, 0x002F, 0x0035], [0x0000, 0x0017, 0xFF01, 0x000A, 0x000B, 0x0023, 0x0010, 0x0005, 0x000D, 0x0012, 0x0033, 0x002D, 0x002B, 0x001B, 0x4469, 0xFE0D]
    whole = client_hello_bytes("example.com", ciphers, ext, "h2", [0x0304, 0x0303], [0x0403])
    got = tls.parse_client_hello(whole)
    assert got["status"] == "parsed" and got["version"] == "1.3" and got["sni_hash"] == "a379a6f6eeafb9a5" and got["alpn"] == "h2"
    assert got["fingerprint"].startswith("t13d1516h2_8daaf6152771_")
    grease = tls.parse_client_hello(client_hello_bytes("example.com", [0x0A0A, *ciphers], ext, "h2", [0x1A1A, 0x0304], [0x0403]))
    assert grease["fingerprint"] == got["fingerprint"]
    assert tls.parse_client_hello(whole[:50])["status"] == "fragmented" and tls.parse_client_hello(b"GET /")["status"] == "not_clienthello" and tls.parse_client_hello(b"")["status"] == "not_clienthello"
    assert tls.parse_server_hello(whole)["status"] == "not_serverhello"
    for k in range(len(whole)):
        tls.parse_client_hello(whole[:k]), tls.parse_client_hello(whole[:k] + b"\xff" + whole[k + 1 :])


def test_server_hello():
    alpn, versions = bytes.fromhex("001000050003026832"), bytes.fromhex("002b00020304")

    def hello(cipher, ext):
        body = b"\x03\x03" + bytes(32) + b"\0" + cipher + b"\0" + len(ext).to_bytes(2, "big") + ext
        return b"\x16\x03\x03" + (len(body) + 4).to_bytes(2, "big") + b"\x02" + len(body).to_bytes(3, "big") + body

    assert tls.parse_server_hello(hello(b"\x13\x01", versions + alpn))["fingerprint"] == "t1302h2_1301_14e9539264dc"
    assert tls.parse_server_hello(hello(b"\xc0\x2f", alpn))["fingerprint"] == "t1201h2_c02f_0b08e3dcc50f"
    assert tls.parse_server_hello(hello(b"\xc0\x2f", alpn)[:20])["status"] == "fragmented"
    assert hashlib.sha256(b"0010").hexdigest()[:12] == "0b08e3dcc50f"


def test_alpn_letters():
    assert [tls._alpn_letters(x) for x in (b"", b"h2", b"http/1.1", b"x", b"\xff\x01")] == ["00", "h2", "h1", "xx", "f1"]


def test_times_beyond_a_long(spark):
    at = lambda ns: one(spark, text.rfc3339(F.lit(ns).cast("decimal(29,0)")))
    assert at("47514000000500000000") == "3475-08-29T13:20:00.5Z"
    assert at("300000000000000000001") == "11476-08-15T05:20:00.000000001Z"
    ends = [one(spark, text.rfc3339(F.lit(ns).cast("long"))) for ns in (2**63 - 1, -1, -(2**63))]
    assert ends == ["2262-04-11T23:47:16.854775807Z", "1969-12-31T23:59:59.999999999Z", "1677-09-21T00:12:43.145224192Z"]
