"""Hosts as browsers read them, against the address library, the punycode codec and listed cases."""

import ipaddress
import random

from pyspark.sql import functions as F

from siftlode.operators import hosts, probes, urls

CASES = {
    "http://2130706433/": "127.0.0.1", "http://0x7f000001/": "127.0.0.1", "http://127.1/": "127.0.0.1", "http://017700000001": "127.0.0.1", "http://0x7f.1": "127.0.0.1", "http://0x.0x.0": "0.0.0.0", "http://1.2.3.": "1.2.0.3", "http://[::ffff:7f00:1]/": "::ffff:7f00:1",
    "http://[::]": "::", "http://[0:0:1::]": "0:0:1::", "http://[1::2:0:0:3]": "1::2:0:0:3", "http://[1:2:3:4:5:6:7::]": "1:2:3:4:5:6:7:0", "http://[::127.0.0.1]": "::7f00:1", "http://EXAMPLE.com:80/x": "example.com", "http://a_b.c-d.org.": "a_b.c-d.org", "http:/\\evil.com\\@good.com/": "evil.com", "http://user:pa:ss@h.org": "h.org",
    "http://ｅｘ．ｃｏｍ": "ex.com", "http://ex%41mple.com": "example.com", "http://BÜCHER.de": "xn--bcher-kva.de", "http://例え。テスト": "xn--r8jz45g.xn--zckzah", "http://\texa\nmple.com ": "example.com", "http://1.2.3.4.example": "1.2.3.4.example", "http://3com.com": "3com.com", "http://0x.example": "0x.example",
    "http://256.1.1.1": None, "http://1.2.3.4.5": None, "http://4294967296": None, "http://1.2.3.0xg": "1.2.3.0xg", "http://08.1.1.1": None, "http://[::1": None, "http://[1:2]": None, "http://[::1::2]": None, "http://[12345::]": None, "http://a b/": None, "http://": None, "ftp://h": None, "": None, "http://a^b": None, "http://[::01.2.3.4]": None, "http://%00a": None, "http://.": None,
}


def test_listed_cases_in_columns_and_in_tasks(spark):
    df = spark.createDataFrame([(u,) for u in [*CASES, None]], "url string")
    got = {r.url: r.h for r in df.select("url", hosts.web_host(F.col("url")).alias("h")).collect()}
    assert got == {**CASES, None: None}
    assert {u: hosts.host_text(u) for u in CASES} == CASES


def test_generated_addresses_and_names(spark):
    rng = random.Random(3)
    v6 = [":".join(f"{rng.choice([0, 0, 0, 1, 0xFC00, 0xFFFF, rng.randrange(65536)]):x}" for _ in range(8)) for _ in range(150)] + ["::ffff:10.0.0.1", "64:ff9b::1", "::", "::1", "fe80::1", "febf::1", "fec0::1", "fdff::", "fe00::"]
    words = ["".join(rng.choice("abzé漢字🚖ßя9-") for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    numbers = [rng.choice([rng.randrange(2**32), 0xA9FE0000 + rng.randrange(65536), 0xAC100000 + rng.randrange(1 << 22)]) for _ in range(100)]
    forms = [f(n) for n in numbers for f in (str, hex, lambda n: f"0{n:o}", lambda n: f"{n >> 24}.{n % (1 << 24)}", lambda n: f"0x{n >> 24:x}.0{n >> 16 & 255:o}.{n % 65536}")]
    df = spark.createDataFrame([("v6", x) for x in v6] + [("name", w) for w in words] + [("v4", x) for x in forms], "kind string, x string")
    url = F.concat(F.lit("http://"), F.when(F.col("kind") == "v6", F.concat(F.lit("["), "x", F.lit("]"))).otherwise(F.col("x")), F.lit("/p"))
    rows = df.select("kind", "x", url.alias("url"), hosts.web_host(url).alias("h"), urls.private_url(url).alias("p"), probes.refused_url(url).alias("q")).collect()
    v4 = {f: n for n, at in zip(numbers, range(0, len(forms), 5), strict=True) for f in forms[at : at + 5]}
    for r in rows:
        assert r.h == hosts.host_text(r.url) and r.p == probes.refused(r.url) == r.q, r
        if r.kind == "v6":
            ip = ipaddress.IPv6Address(r.x)
            assert ipaddress.IPv6Address(r.h) == ip and (ip.ipv4_mapped or r.h == ip.compressed)
            inner = ipaddress.IPv4Address(int(ip) % 2**32) if int(ip) >> 32 in (0, 0xFFFF) else None
            nets = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16") if inner else ("fc00::/7", "fe80::/10")
            assert r.p == any((inner or ip) in ipaddress.ip_network(n) for n in nets)
        elif r.kind == "v4":
            assert r.h == str(ipaddress.IPv4Address(v4[r.x]))
        elif not r.x.lower().isascii():
            assert r.h == "xn--" + r.x.lower().encode("punycode").decode()


def test_names_of_this_network_and_what_they_resolve_to(spark):
    for u, bad in {"http://localhost./": True, "http://x.LOCALHOST": True, "http://a.local": True, "http://locale.org": False, "http://fcbooks.com": False, "http://8.8.8.8": False, "http://[2001:db8::1]": False}.items():
        assert probes.refused(u) == bad and spark.range(1).select(urls.private_url(F.lit(u)).alias("p")).first().p == bad
    assert probes.refused("http://ok.org", lambda h: ["93.184.216.34", "::ffff:10.0.0.1"]) and not probes.refused("http://ok.org", lambda h: ["93.184.216.34"])
