"""Audit of captured connections, and vetting of address literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


# fixed values: reverse names that explain an address no expected host resolves to
REVERSE_NAMES = [
    (["scw.cloud", "scaleway"], "EXPECTED", "Scaleway (by reverse name)"),
    (["github.com", "githubusercontent"], "EXPECTED", "GitHub (by reverse name)"),
    (["ovh.net", "kepler"], "EXPECTED", "OVHcloud (by reverse name)"),
    (["apple.com", "aaplimg", "akadns", "icloud"], "OS", "Apple — certificate checks, not the app"),
]


def explained(captures: DataFrame, expected: DataFrame, reverse: DataFrame) -> DataFrame:
    """Add ``class`` and ``what`` to captured endpoints (phase, source, remote).

    ``expected`` maps addresses to hosts as resolved forward and wins over
    ``reverse``, the addresses' reverse names, which are matched by pattern. Of
    several hosts or names of an address the first ``listed`` counts.
    """
    ip = F.regexp_extract("remote", r"^(.*):[^:]*$", 1)
    hosts = expected.groupBy("ip").agg(F.min_by(F.struct("host", "what"), F.struct("listed", "host", "what")).alias("host"))
    names = reverse.groupBy("ip").agg(F.min_by("name", F.struct("listed", "name")).alias("reverse_name"))
    joined = (
        captures.withColumn("ip", ip)
        .join(hosts, "ip", "left")
        .join(names, "ip", "left")
    )
    cls, what = F.when(F.col("host").isNotNull(), "EXPECTED"), F.when(
        F.col("host").isNotNull(), F.concat_ws(" — ", F.col("host.host"), F.col("host.what"))
    )
    for patterns, verdict, said in REVERSE_NAMES:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.contains("reverse_name", F.lit(p))
        cls, what = cls.when(hit, verdict), what.when(hit, said)
    return joined.withColumns({"class": cls.otherwise("UNEXPLAINED"), "what": what}).drop("host")


def endpoint_report(captures: DataFrame, expected: DataFrame, reverse: DataFrame) -> DataFrame:
    """Each endpoint once per phase and source; contact while idle, or by the
    webview at all, is a finding whoever answers, and an endpoint may give both."""
    endpoints = captures.select("phase", "source", "remote").distinct()
    found = F.concat_ws(", ", F.when(F.col("source") == "webview", "webview contact"), F.when(F.col("phase") == "idle", "idle contact"))
    finding = F.nullif(found, F.lit(""))
    return explained(endpoints, expected, reverse).select("phase", "source", "remote", "class", "what", finding.alias("finding"))


def capture_verdict(captures: DataFrame, expected: DataFrame, reverse: DataFrame) -> DataFrame:
    """One row: distinct endpoints, how many are unexplained, PASS or REVIEW."""
    endpoints = captures.select("remote").distinct()
    return explained(endpoints, expected, reverse).agg(
        F.count(F.lit(1)).alias("endpoints"), F.count_if(F.col("class") == "UNEXPLAINED").alias("unexplained")
    ).withColumn("verdict", F.when(F.col("unexplained") == 0, "PASS").otherwise("REVIEW"))


# fixed values: IPv4 ranges that no public page lives in
PRIVATE_V4 = [
    ("0.0.0.0", 8, "this network"), ("10.0.0.0", 8, "private"), ("100.64.0.0", 10, "carrier-grade NAT"),
    ("127.0.0.0", 8, "loopback"), ("169.254.0.0", 16, "link-local"), ("172.16.0.0", 12, "private"),
    ("192.0.0.0", 24, "protocol assignments"), ("192.0.2.0", 24, "documentation"), ("192.168.0.0", 16, "private"),
    ("198.18.0.0", 15, "benchmarking"), ("198.51.100.0", 24, "documentation"), ("203.0.113.0", 24, "documentation"),
    ("224.0.0.0", 4, "multicast"), ("240.0.0.0", 4, "reserved"),
]
# fixed values: IPv6 prefixes that no public page lives in
PRIVATE_V6 = [
    ("::", 127, "loopback or unspecified"), ("64:ff9b::", 96, "NAT64"), ("64:ff9b:1::", 48, "NAT64"), ("100::", 64, "discard"),
    ("2001::", 32, "Teredo"), ("2001:db8::", 32, "documentation"), ("2002::", 16, "6to4"), ("fc00::", 7, "unique local"),
    ("fe80::", 10, "link-local"), ("fec0::", 10, "site-local"), ("ff00::", 8, "multicast"),
]
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def ipv4_number(address: Column) -> Column:
    """Dotted quad as a number, null when it is not one."""
    parts = F.split(address, r"\.")
    value = F.aggregate(F.transform(parts, lambda p: p.try_cast("long")), F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    return F.when(address.rlike(rf"^{_QUAD}$"), value)


def ipv6_number(address: Column) -> Column:
    """An IPv6 address in any of its spellings as (hi, lo), two longs that hold 64 bits each; null when it is not one.

    A dotted quad may end it, ``::`` may stand for one or more groups of zeros,
    and a zone may follow.
    """
    bare = F.regexp_replace(F.lower(address), r"%[^%]+$", "")
    quad = ipv4_number(F.regexp_extract(bare, rf":({_QUAD})$", 1))
    ends = F.concat(
        F.regexp_replace(bare, r"[0-9.]+$", ""), F.lower(F.hex(F.shiftright(quad, 16))), F.lit(":"), F.lower(F.hex(quad.bitwiseAND(F.lit(0xFFFF))))
    )
    # bound to a variable, so that the text is not put together once for every use
    return F.transform(F.array(F.coalesce(ends, bare)), _of_groups)[0]


def _of_groups(text: Column) -> Column:
    sides = F.split(text, "::", -1)
    listed = lambda side: F.filter(F.split(side, ":", -1), lambda g: side != "")
    left, right = listed(sides[0]), listed(F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")))
    zeros = F.lit(8) - F.size(left) - F.size(right)
    shape = ((F.size(sides) == 1) & (zeros == 0)) | ((F.size(sides) == 2) & (zeros >= 1))
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), right)
    valid = shape & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    half = lambda at: F.aggregate(
        F.slice(groups, at, 4), F.lit(0).cast("long"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(F.conv(g, 16, 10).cast("long"))
    )
    return F.when(valid, F.struct(half(1).alias("hi"), half(5).alias("lo")))


def address_number(address: Column) -> Column:
    """(family, hi, lo) of an address literal, null when it is none.

    A v6 address that carries a v4 one, mapped or compatible, is that v4
    address. Brackets may stand round v6.
    """
    bare = F.regexp_replace(address, r"^\[(.*:.*)\]$", "$1")
    v4 = ipv4_number(bare)

    def of(v6: Column) -> Column:
        high = F.shiftrightunsigned(v6["lo"], 32)
        carried = (v6["hi"] == 0) & ((high == 0xFFFF) | ((high == 0) & (v6["lo"] > 1)))
        return F.when(carried, F.struct(F.lit(4).alias("family"), F.lit(0).cast("long").alias("hi"), v6["lo"].bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))).when(
            v6.isNotNull(), F.struct(F.lit(6).alias("family"), v6["hi"].alias("hi"), v6["lo"].alias("lo"))
        )

    return F.when(v4.isNotNull(), F.struct(F.lit(4).alias("family"), F.lit(0).cast("long").alias("hi"), v4.alias("lo"))).otherwise(
        F.transform(F.array(ipv6_number(bare)), of)[0]
    )


def _first_byte(number: Column) -> Column:
    """The first byte of an address: what a prefix is joined on."""
    return F.when(number["family"] == 4, F.shiftright(number["lo"], 24)).otherwise(F.shiftrightunsigned(number["hi"], 56)).cast("int")


def private_ranges(spark) -> DataFrame:
    """(family, first, mask_hi, mask_lo, net_hi, net_lo, reason): a row per first byte that a prefix covers."""
    rows = ", ".join(f"('{net}', {bits}, '{why}')" for net, bits, why in [*PRIVATE_V4, *PRIVATE_V6])
    ranges = spark.sql(f"SELECT * FROM VALUES {rows} AS r(net, bits, reason)").withColumn("n", address_number(F.col("net")))
    net = F.col("n")
    v4 = net["family"] == 4
    high = F.when(v4, 0).otherwise(F.least("bits", F.lit(64)))
    low = F.when(v4, F.col("bits") + 32).otherwise(F.greatest(F.col("bits") - 64, F.lit(0)))
    ones = lambda n: f"CASE WHEN {n} = 0 THEN 0L ELSE shiftleft(-1L, 64 - {n}) END"
    masked = ranges.withColumns({"high": high, "low": low}).withColumns({
        "mask_hi": F.expr(ones("high")), "mask_lo": F.expr(f"{ones('low')} & CASE WHEN n.family = 4 THEN 4294967295L ELSE -1L END"),
    })
    from_, width = _first_byte(net), F.greatest(F.lit(8) - F.col("bits"), F.lit(0))
    covered = F.sequence(from_, (from_ + F.pow(F.lit(2), width) - 1).cast("int"))
    return masked.select(
        net["family"].alias("family"), F.explode(covered).alias("first"), "mask_hi", "mask_lo",
        net["hi"].alias("net_hi"), net["lo"].alias("net_lo"), "reason",
    )


def vetted_addresses(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add ``reason``: why an address literal may not be fetched, null when it may.

    Addresses are numbers, so every spelling of one has the same answer. The
    prefix join is an equi-join on family and first byte with the rest of the
    prefix as its residual; prefixes do not overlap.
    """
    numbered = addresses.withColumn("__n", address_number(F.col("address")))
    keyed = numbered.withColumns({"__family": F.col("__n.family"), "__first": _first_byte(F.col("__n"))})
    held = (
        (F.col("__family") == F.col("family")) & (F.col("__first") == F.col("first"))
        & (F.col("__n.hi").bitwiseAND(F.col("mask_hi")) == F.col("net_hi")) & (F.col("__n.lo").bitwiseAND(F.col("mask_lo")) == F.col("net_lo"))
    )
    return keyed.join(ranges, held, "left").select(
        *addresses.columns, F.when(F.col("__n").isNull(), "not an address").otherwise(F.col("reason")).alias("reason")
    )
