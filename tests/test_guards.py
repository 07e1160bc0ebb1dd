import ipaddress
import random
import socket

from pyspark.sql import functions as F

from hushframe.functions import scalars
from hushframe.sources import files

NETWORKS = [ipaddress.ip_network(n) for n in (*scalars.PRIVATE_NETWORKS, "::1/128", "fc00::/7", "fe80::/10")]


def column(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.r for r in df.select("i", function(F.col("t")).alias("r")).orderBy("i").collect()]


def private(address):
    if isinstance(address, ipaddress.IPv6Address):
        number = int(address)
        if number >> 32 in (0, 0xFFFF):  # compatible and mapped
            address = ipaddress.IPv4Address(number & 0xFFFFFFFF)
    return any(address in n for n in NETWORKS if n.version == address.version)


def test_ipv4_in_all_forms_that_resolvers_take(spark):
    dice, hosts = random.Random(3), ["127.1", "0x7f000001", "0177.0.0.1", "2130706433", "0", "010.0.0.1", "10.0.0.1.", "192.168.257", "1.2.3.4.5", "08.1.1.1", "256.1.1.1", "1..2", "", "0x", "4294967296", "4294967295", "1e3", "0x7F.1", "10.0x10001"]
    number = lambda n: dice.choice((str(n), hex(n), "0" + oct(n)[2:], hex(n).upper().replace("0X", "0x")))
    for _ in range(600):
        n = dice.randint(1, 4)
        parts = [dice.choice((10, 127, 172, 192, 169, 100, 0, dice.randrange(300))) for _ in range(n - 1)]
        last = dice.randrange(256 ** (5 - n) + (3 if dice.random() < 0.1 else 0))
        hosts.append(".".join(map(number, [*parts, last])))
    got = column(spark, hosts, scalars.private_host)
    for host, answer in zip(hosts, got, strict=True):
        try:
            want = private(ipaddress.IPv4Address(socket.inet_aton(host.rstrip("."))))if host.strip(".") else False
        except OSError:
            want = False
        assert answer == want, host


def test_ipv6_however_abbreviated(spark):
    dice, hosts = random.Random(4), ["::", "::1", "::ffff:127.0.0.1", "::ffff:7f00:1", "0:0:0:0:0:ffff:7f00:1", "::127.0.0.1", "fe80::1%eth0", "1:2:3:4:5:6:7", "1::2::3", "12345::", ":::", "::g", "1:2:3:4:5:6:7:8:9", "::ffff:999.1.1.1", "64:ff9b::8.8.8.8"]
    for _ in range(500):
        head = dice.choice((0, 0xFC00, 0xFDFF, 0xFE00, 0xFE80, 0xFEBF, 0xFEC0, 0x2001))
        address = ipaddress.IPv6Address(dice.choice((dice.randrange(1 << 112) | head << 112, 0xFFFF << 32 | dice.choice((0x0A000001, 0x7F000001, 0x08080808)), dice.randrange(1 << 20))))
        hosts.append(dice.choice((address.compressed, address.exploded, address.compressed.upper(), f"[{address.compressed}]")))
    got = column(spark, hosts, scalars.private_host)
    for host, answer in zip(hosts, got, strict=True):
        try:
            want = private(ipaddress.IPv6Address(host.strip("[]").split("%")[0]))
        except ValueError:
            want = False
        assert answer == want, host


def test_urls(spark):
    urls = ["http://2130706433/", "http://0x7f000001/x", "http://0177.0.0.1:80", "http://127.1/", "http://[::ffff:7f00:1]/", "https://93.184.216.34/", "http://example.org/", None]
    assert column(spark, urls, scalars.url_refused) == ["private"] * 5 + [None] * 3


def test_all_references_of_html(spark):
    texts = ["caf&eacute; &rarr; &hearts;&nbsp;x &amp;lt; &#8364;&#x1F600; &bogus; &", "a & b &amp", None, "", "no reference"]
    assert column(spark, texts, scalars.unescaped) == ["café → ♥\xa0x &lt; €😀 &bogus; &", "a & b &", None, "", "no reference"]
    assert column(spark, ["<p>caf&eacute; <b>&rarr;</b></p>"], scalars.without_tags) == ["café →"]


def test_references_that_a_cut_left_open_stay(spark):
    texts = ["<h1>a&amp;&amp</h1>b &lt;&#39;&#x27;&#39 &notit; &amp;lt;", None]
    assert column(spark, texts, lambda c: scalars.without_tags(c, closed=True)) == ["a&&ampb <''&#39 &notit; &lt;", None]
    assert column(spark, texts, lambda c: scalars.markdown(c, closed=True)) == ["# a&&amp\nb <''&#39 &notit; &lt;", None]


def test_an_artifact_written_again_takes_the_place_of_the_one_before(spark, tmp_path):
    table = lambda *rows: spark.createDataFrame([(s, t, "c", n, p.encode()) for s, t, n, p in rows], "session string, turn long, call string, name string, payload binary")
    path = str(tmp_path / "artifacts")
    files.write_artifacts(table(("s", 1, "x/a.txt", "one"), ("s", 1, "b.txt", "b"), ("t", 1, "a.txt", "t"), (None, 1, "n", "n")), path)
    files.write_artifacts(table(("s", 1, "a.txt", "two"), ("s", 2, "a.txt", "three"), (None, 1, "n", "m")), path)
    files.write_artifacts(table(("u", 1, "a", "1"), ("u", 1, "a", "2")), path)
    got = {(r.session, r.turn, r.name): bytes(r.payload).decode() for r in spark.read.parquet(path).collect()}
    assert len(spark.read.parquet(path).collect()) == len(got) == 6
    assert got["s", 1, "a.txt"] == "two" and got["s", 1, "b.txt"] == "b" and got["s", 2, "a.txt"] == "three" and got["t", 1, "a.txt"] == "t" and got[None, 1, "n"] == "m" and got["u", 1, "a"] in "12"


def test_a_log_keeps_sessions_that_share_a_folder(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(f"s{i}", i, "old") for i in range(60)], "session string, turn long, payload string")
    files.append_log(rows, path)
    files.replace_log(spark.createDataFrame([("s7", 100, "new"), ("s7", 101, "new"), ("x", 1, "new")], rows.schema), path)
    got = sorted((r.session, r.turn, r.payload) for r in files.read_log(spark, path, "session string, turn long, payload string").collect())
    assert got == sorted([(f"s{i}", i, "old") for i in range(60) if i != 7] + [("s7", 100, "new"), ("s7", 101, "new"), ("x", 1, "new")])
