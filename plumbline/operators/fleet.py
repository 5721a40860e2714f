"""The fleet graph: segments, trust, adjacency, reachability, correlations and the ranking of fixes.

Nodes and edges are tables.  Addresses are runs of hex digits, eight of IPv4 and 32 of IPv6, so
containment in a declared network is an equi-join on (digits, prefix length, leading bits) for both.
Reachability runs breadth first, all (segment, port) sweeps at once, at most six segments deep.

What most steps read is one table, ``members``: a row per interface and segment.  It is worked out and
staged once (``graph``) and handed on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.reuse import per_session
from plumbline.functions.scalars import address_digits, digits_address, leading_bits, port_matches
from plumbline.operators.relational import pairs_within
from plumbline.sources.tables import staged

HOPS, ENTRIES, PATHS, DEVICES = 6, 8, 10, 12
#: More than a device has interfaces.
PLACES = 1 << 32
#: The place of a step in a sweep: the device, the interfaces in and out, the address of the way out.
ORDER = "array<struct<device_id:string,place:int,out:int,n:int>>"
#: Fixed: words that mark an interface, the services that are looked for, and weights of findings.
UNTRUSTED = r"(?i)\b(untrust|internet|isp|wan|outside|public|external|uplink-to-isp|transit)\b"
MANAGEMENT = r"(?i)\b(mgmt|management|oob|out-of-band)\b"
SERVICES = {"telnet": ("mgmt.telnet_enabled", 23), "http": ("mgmt.http_enabled", 80), "https": ("mgmt.https_enabled", 443), "ssh": ("mgmt.ssh.enabled", 22)}
WEIGHT = {"critical": 8, "high": 5, "medium": 2, "low": 1}
#: Fixed: IPv4 ranges that are not globally routable.
PRIVATE = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]


def _range(cidr: str) -> tuple[int, int]:
    a, n = cidr.split("/")
    lo = 0
    for part in a.split("."):
        lo = lo * 256 + int(part)
    return lo, lo + (1 << (32 - int(n))) - 1


def is_global(digits: Column) -> Column:
    """Whether an IPv4 address is globally routable; false for others."""
    number, out = F.conv(F.left(digits, F.lit(8)), 16, 10).cast("long"), F.length(digits) == 8
    for cidr in PRIVATE:
        lo, hi = _range(cidr)
        out = out & ~((number >= lo) & (number <= hi))
    return out


def interfaces(docs: DataFrame) -> DataFrame:
    """One row per interface of ``docs``."""
    acls = F.coalesce("acls", F.array().cast(docs.schema["acls"].dataType))
    rows = docs.select("device_id", acls.alias("acls"), F.posexplode("interfaces").alias("place", "i"))
    entries = F.get(F.filter("acls", lambda a: a["name"] == F.col("i.acl_in")), F.lit(0))["entries"]
    return rows.select("device_id", "place", "i.*", entries.alias("entries"))


def graph(docs: DataFrame) -> DataFrame:
    """``members(docs)``, staged: what the other steps of a fleet read."""
    return staged(members(docs), "members")


def members(docs: DataFrame) -> DataFrame:
    """device_id, place, n (of the address), name, segment, inferred, trust, shutdown, entries: interfaces in their networks.

    A bare address joins the first declared network that holds it, else its /24 (/64 in IPv6).  An
    interface with one inferred network is inferred in all of them.  Trust: management before untrusted
    words before a global IPv4 network before internal.
    """
    rows = interfaces(docs).select("device_id", "place", "name", "zone", "description", "shutdown", "is_mgmt", "entries", F.posexplode("addresses").alias("n", "address"))
    bits = F.length("digits") * 4
    rows = rows.withColumn("digits", _digits()).withColumn("length", F.when(F.contains("address", F.lit("/")), F.split_part("address", F.lit("/"), F.lit(2)).try_cast("int")))
    rows = rows.where((F.col("digits").isNotNull()) & (F.col("length").isNull() | ((F.col("length") >= 0) & (F.col("length") <= bits)) & F.contains("address", F.lit("/"))))
    own = rows.where("length is not null").withColumn("bits", leading_bits(F.col("digits"), F.col("length")))
    declared = own.groupBy(F.length("digits").alias("size"), "length", "bits").agg(F.min(F.struct("device_id", "place", "n")).alias("order"))
    # a bare address is looked up once, and at the lengths that some network has: 33 and 129 at most
    bare = rows.where("length is null").drop("length")
    known = declared.select("size", "length").distinct()
    asked = bare.select("digits", F.length("digits").alias("size")).distinct().join(F.broadcast(known), "size").withColumn("bits", leading_bits(F.col("digits"), F.col("length")))
    nets = asked.join(declared.hint("merge"), ["size", "length", "bits"]).groupBy("digits").agg(F.min(F.struct("order", F.struct("length", "bits").alias("net"))).alias("x"))
    keys = ["device_id", "place", "name", "n"]
    found = bare.join(nets.select("digits", "x.net").hint("merge"), "digits", "left").select(*keys, "net", "digits", "zone", "description", "shutdown", "is_mgmt", "entries")
    usual = F.when(F.length("digits") == 8, 24).otherwise(64)
    found = found.withColumn("net", F.coalesce("net", F.struct(usual.alias("length"), leading_bits(F.col("digits"), usual).alias("bits")))).withColumn("inf", F.lit(True))
    every = own.withColumn("net", F.struct("length", "bits")).withColumn("inf", F.lit(False)).select(*found.columns).unionByName(found)
    base = F.rpad("net.bits", F.length("digits"), F.lit("0"))
    every = every.withColumn("base", base).withColumn("segment", _segment_text())
    w = W.partitionBy("device_id", "place")
    every = every.withColumn("inferred", F.max("inf").over(w)).withColumn("outside", F.max(is_global(F.col("base"))).over(w))
    every = every.withColumn("trust", _trust(F.col("outside")))
    once = F.row_number().over(W.partitionBy("device_id", "place", "segment").orderBy("n"))
    return every.withColumn("k", once).where("k = 1").select("device_id", "place", "n", "name", "segment", "base", "inferred", "trust", "shutdown", "entries")


@per_session
def _digits() -> Column:
    return address_digits(F.split_part("address", F.lit("/"), F.lit(1)))


@per_session
def _open_ports() -> Column:
    """The ports that an interface lets in."""
    return F.filter(F.array(*(F.when(F.coalesce(permits(F.col("entries"), F.lit(p)), F.lit(True)), F.lit(p)) for _, p in SERVICES.values())), lambda p: p.isNotNull())


@per_session
def _segment_text() -> Column:
    return F.concat(digits_address(F.col("base")), F.lit("/"), F.col("net.length").cast("string"))


def _trust(outside: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce("zone", F.lit("")), F.coalesce("description", F.lit("")))
    return F.when(F.col("is_mgmt") | text.rlike(MANAGEMENT), "management").when(text.rlike(UNTRUSTED) | F.coalesce(outside, F.lit(False)), "untrusted").otherwise("internal")


def classified(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """All interfaces with their trust, also those without an address."""
    held = members(docs) if held is None else held
    outside = held.groupBy("device_id", "place").agg(F.max(is_global(F.col("base"))).alias("outside"))
    return interfaces(docs).join(outside, ["device_id", "place"], "left").withColumn("trust", _trust(F.col("outside")))


def nodes(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """id, kind, label of devices, interfaces, segments, services and shared credentials; the last label of
    an id counts."""
    held = members(docs) if held is None else held
    d = docs.select(F.concat(F.lit("device:"), "device_id").alias("id"), F.lit("device").alias("kind"), F.coalesce("device.hostname", "device_id").alias("label"))
    i = interfaces(docs).select(F.concat_ws(":", F.lit("iface"), "device_id", "name"), F.lit("interface"), F.col("name"))
    s = held.select(F.concat(F.lit("segment:"), "segment"), F.lit("segment"), F.col("segment"))
    v = trusts(docs).select("service", F.lit("service"), F.regexp_replace(F.regexp_replace("service", "^service:", ""), ":", " "))
    c = credentials(docs).select(F.concat(F.lit("credential:"), "fingerprint"), F.lit("credential"), F.left("fingerprint", F.lit(8)))
    every = d.union(i).union(s).union(v).union(c)
    return every.groupBy("id").agg(F.max("kind").alias("kind"), F.max("label").alias("label"))


def edges(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """src, dst, kind: interfaces of devices, their segments, trusted services and shared credentials."""
    held = members(docs) if held is None else held
    one = F.concat_ws(":", F.lit("iface"), "device_id", "name")
    has = interfaces(docs).select(F.concat(F.lit("device:"), "device_id").alias("src"), one.alias("dst"), F.lit("has").alias("kind"))
    inside = held.select(one, F.concat(F.lit("segment:"), "segment"), F.lit("member"))
    leans = trusts(docs).select("src", "service", F.lit("trusts"))
    keeps = holders(docs).select(F.concat(F.lit("device:"), "device_id"), F.concat(F.lit("credential:"), "fingerprint"), F.lit("credential"))
    return has.union(inside).union(leans).union(keeps).distinct()


def neighbours(links: DataFrame, of: DataFrame) -> DataFrame:
    """id, neighbour: the other ends of the edges at the nodes ``of`` (id), whichever way they point."""
    both = links.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).union(links.select("dst", "src"))
    return both.join(of.select("id").distinct(), "id").distinct()


def trusts(docs: DataFrame) -> DataFrame:
    """Edges from devices to the syslog, ntp and aaa hosts that they depend on."""
    listed = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(p).alias("hosts")) for k, p in (("syslog", "logging.servers"), ("ntp", "ntp.servers"), ("aaa", "aaa.servers"))))
    rows = docs.select("device_id", F.explode(listed).alias("x")).select("device_id", "x.kind", F.explode("x.hosts").alias("host"))
    return rows.select(F.concat(F.lit("device:"), "device_id").alias("src"), F.concat_ws(":", F.lit("service"), "kind", "host").alias("service")).distinct()


def holders(docs: DataFrame) -> DataFrame:
    """fingerprint, device_id, account, n_accounts of credentials that two or more accounts hold."""
    rows = docs.select("device_id", F.explode("aaa.local_users").alias("u")).where("u.hash_fingerprint is not null")
    rows = rows.select(F.col("u.hash_fingerprint").alias("fingerprint"), "device_id", F.concat_ws(":", "device_id", F.col("u.name")).alias("account"))
    counts = rows.groupBy("fingerprint").agg(F.count("*").alias("n_accounts")).where("n_accounts >= 2")
    return rows.join(counts, "fingerprint")


def credentials(docs: DataFrame) -> DataFrame:
    """fingerprint, accounts (the first by name, ``DEVICES`` at most), n_accounts, devices, n_devices of
    credentials that two or more accounts hold.

    Counts cover all holders and are partial aggregates; the lists are of what is shown.
    """
    held = holders(docs)
    devices = held.select("fingerprint", "device_id").distinct()
    place = lambda c: F.row_number().over(W.partitionBy("fingerprint").orderBy(c))
    first = held.withColumn("k", place("account")).where(F.col("k") <= DEVICES).groupBy("fingerprint", "n_accounts").agg(F.sort_array(F.collect_list("account")).alias("accounts"))
    known = devices.withColumn("k", place("device_id")).groupBy("fingerprint").agg(F.count("*").alias("n_devices"), F.sort_array(F.collect_list(F.when(F.col("k") <= DEVICES, F.col("device_id")))).alias("devices"))
    return first.join(known, "fingerprint")


def segments(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """segment, interfaces, devices, links: the adjacency of a fleet by classes.

    Interfaces of different devices on one segment are adjacent; ``links`` counts such pairs, which need
    not be made: all pairs less those within a device.
    """
    held = members(docs) if held is None else held
    own = held.groupBy("segment", "device_id").agg(F.count("*").alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    sums = own.groupBy("segment").agg(F.sum("n").alias("interfaces"), F.count("*").alias("devices"), F.sum(pairs("n")).alias("same"))
    return sums.select("segment", "interfaces", "devices", (pairs("interfaces") - F.col("same")).cast("long").alias("links"))


def adjacency(docs: DataFrame, most: int, held: DataFrame | None = None) -> DataFrame:
    """Pairs of interfaces of different devices on one segment, each once: an equi-join on the segment.

    A segment with more than ``most`` interfaces raises: its pairs are told by ``segments``.
    """
    held = members(docs) if held is None else held
    m = held.withColumn("who", F.struct("device_id", "place", F.concat_ws(":", "device_id", "name").alias("label")))
    pairs = pairs_within(m, "segment", "who", most).where("a.device_id <> b.device_id")
    return pairs.select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), "segment")


def permits(entries: Column, port: Column) -> Column:
    """Whether an access list lets a port pass: the first entry that decides; null without a list.

    Entries whose action is neither permit nor deny decide nothing.
    """
    decides = lambda e: F.coalesce(F.lower(e["protocol"]), F.lit("")).isin("ip", "tcp", "any", "") & (e["dst_port"].isNull() | port_matches(e["dst_port"], port)) & e["action"].isin("permit", "deny")
    first = F.get(F.filter(entries, decides), F.lit(0))["action"]
    return F.when(entries.isNull() | (F.size(entries) == 0), F.lit(None).cast("boolean")).otherwise(F.coalesce(first == "permit", F.lit(False)))


def entry_groups(held: DataFrame) -> DataFrame:
    """start, from, at: the untrusted interfaces that are up, by segment, at most ``ENTRIES`` of each."""
    rows = held.where("trust = 'untrusted' and not shutdown").withColumn("n", F.row_number().over(W.partitionBy("segment").orderBy("device_id", "place")))
    return rows.where(F.col("n") <= ENTRIES).select(F.col("segment").alias("start"), F.col("device_id").alias("from"), F.col("name").alias("at"))


def sweeps(held: DataFrame) -> DataFrame:
    """start, port, device_id, interface, hops, inferred, depth: first arrivals of all sweeps over ``members``.

    Sweeps start on the segments of untrusted interfaces that are up, one per segment and port, and go breadth first:
    segments in the order in which they were found, interfaces of a segment by device and place, and the ways out of a
    device by place and address.  A segment is entered once per sweep, on the first way to it.  ``order`` carries that
    order along: the places of all steps so far, compared from the first one on, as a queue would serve them.

    Of the ways from one segment to another the first one by device, places and address counts, whatever the sweep,
    so they are worked out once a port (``links``), and sweeps go over segments; devices come in at the end."""
    ports = [p for _, p in SERVICES.values()]
    m = held.where("not shutdown")
    if "n" not in m.columns:
        m = m.withColumn("n", F.lit(0))
    # which ports an interface lets in is worked out once, before the sweeps
    m = staged(m.select("segment", "device_id", "place", "n", "name", F.col("inferred").alias("inf"), "trust", _open_ports().alias("ports")), "ways")
    ways = staged(links(m), "links")
    starts = m.where("trust = 'untrusted'").select(F.col("segment").alias("start")).distinct().withColumn("port", F.explode(F.array(*map(F.lit, ports))))
    front = staged(starts.select("start", "port", F.col("start").alias("segment"), F.array("start").alias("hops"), F.lit(False).alias("inferred"), F.array().cast(ORDER).alias("order"), F.lit(0).alias("depth")), "front")
    seen, every = front.select("start", "port", "segment"), front
    for depth in range(1, HOPS):
        onward = front.drop("depth").join(ways, ["port", "segment"]).drop("segment").withColumnRenamed("to", "segment").join(seen, ["start", "port", "segment"], "left_anti")
        order = F.concat("order", F.array(F.struct("x.device_id", "x.place", "x.out", "x.n")).cast(ORDER))
        way = F.struct(F.concat("hops", F.array(F.concat_ws(":", "x.device_id", "x.out_name"), F.col("segment"))).alias("hops"), (F.col("inferred") | F.col("x.inf")).alias("inferred"), order.alias("order"))
        step = onward.groupBy("start", "port", "segment").agg(F.min_by(way, order).alias("way"))
        front = staged(step.select("start", "port", "segment", "way.*", F.lit(depth).alias("depth")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("start", "port", "segment"))
        every = every.unionByName(front)
    # a device is met first in the first segment that lets the port in there, by the number of the segment in its sweep
    number = F.row_number().over(W.partitionBy("start", "port").orderBy("depth", "order")).cast("long")
    reached = staged(every.withColumn("number", number).drop("order"), "reached")
    enter = m.select("segment", "device_id", "place", F.explode("ports").alias("port"))
    first = reached.select("start", "port", "segment", "number").join(enter, ["port", "segment"]).groupBy("start", "port", "device_id").agg(F.min(F.col("number") * PLACES + F.col("place")).alias("at"))
    first = first.select("start", "port", "device_id", F.expr(f"at div {PLACES}").alias("number"), (F.col("at") % PLACES).cast("int").alias("place"))
    met = first.join(reached, ["start", "port", "number"]).join(m.select("segment", "device_id", "place", "name", "inf"), ["segment", "device_id", "place"])
    way = F.concat("hops", F.array(F.concat_ws(":", "device_id", "name")))
    return met.select("start", "port", "device_id", F.col("name").alias("interface"), way.alias("hops"), (F.col("inferred") | F.col("inf")).alias("inferred"), "depth")


def links(m: DataFrame) -> DataFrame:
    """port, segment, to, x: the first way through a device from a segment to another one, for each port that it lets in."""
    outs = m.select("device_id", F.col("place").alias("out"), F.col("n").alias("out_n"), F.col("name").alias("out_name"), F.col("segment").alias("to"), F.col("inf").alias("out_inf"))
    through = m.where(F.size("ports") > 0).select("device_id", "place", "inf", "segment", "ports").join(outs.hint("merge"), "device_id").where("out <> place and to <> segment")
    x = F.struct("device_id", "place", "out", F.col("out_n").alias("n"), "out_name", (F.col("inf") | F.col("out_inf")).alias("inf"))
    # most lists let in the same ports: a row for each such set, before a row for each port
    sets = through.groupBy("segment", "to", "ports").agg(F.min(x).alias("x"))
    return sets.select(F.explode("ports").alias("port"), "segment", "to", "x").groupBy("port", "segment", "to").agg(F.min("x").alias("x"))


EVIDENCE = "array<struct<device:string,ir_path:string,detail:string>>"


def exposures(docs: DataFrame, held: DataFrame) -> DataFrame:
    """Per device and management service without an access list: the untrusted ways in."""
    on = F.array(*(F.when(F.col(p), F.struct(F.lit(s).alias("service"), F.lit(port).alias("port"))) for s, (p, port) in SERVICES.items()))
    open_ = docs.where("mgmt.mgmt_acl is null").select("device_id", F.coalesce("device.hostname", "device_id").alias("label"), F.explode(F.filter(on, lambda s: s.isNotNull())).alias("s")).select("device_id", "label", "s.*")
    ways = sweeps(held).join(open_, ["device_id", "port"]).join(entry_groups(held), "start")
    source = F.concat_ws(":", "from", "at")
    direct = (F.col("from") == F.col("device_id")) & (F.col("at") == F.col("interface"))
    path = F.struct(source.alias("source"), F.when(direct, source).otherwise(F.concat_ws(":", "device_id", "interface")).alias("target"), F.when(direct, F.array(source)).otherwise(F.concat(F.array(source), "hops")).alias("hops"), (F.col("inferred") & ~direct).alias("inferred"))
    found = ways.groupBy("device_id", "label", "service").agg(F.array_sort(F.collect_set(path)).alias("all"), F.array_sort(F.collect_set(source)).alias("sources"), F.max(F.col("inferred") & ~direct).alias("inf"))
    n = F.size("sources")
    host = lambda s: F.split_part(s, F.lit(":"), F.lit(1))
    more = F.when(n > 4, F.concat(F.lit(" and "), (n - 4).cast("string"), F.lit(" more"))).otherwise("")
    cited = F.concat(
        F.array(F.struct(F.col("device_id").alias("device"), F.lit("mgmt.mgmt_acl").alias("ir_path"), F.lit("no management access list, so every host that gets there may try").alias("detail"))),
        F.transform(F.slice("sources", 1, 3), lambda s: F.struct(host(s).alias("device"), F.lit("interfaces[]").alias("ir_path"), F.concat(F.lit("untrusted interface "), F.regexp_replace(s, "^[^:]*:", "")).alias("detail"))),
    )
    fixes = F.concat(F.array(F.concat(F.lit("Apply a management access list on "), "label", F.lit(" (CIS-NET-1.4.1): it cuts every path at once"))), F.transform(F.slice("sources", 1, 3), lambda s: F.concat(F.lit("Or filter "), "service", F.lit(" inbound on "), s)))
    return found.select(
        F.upper(F.concat_ws("-", F.lit("FLEET-EXPOSURE"), "device_id", "service")).alias("id"), F.lit("critical").alias("severity"),
        F.concat(F.col("label"), F.lit(": "), F.col("service"), F.lit(" management is reachable from "), n.cast("string"), F.when(n == 1, " untrusted entry point").otherwise(" untrusted entry points")).alias("title"),
        F.concat("label", F.lit(" has no management access list, and "), "service", F.lit(" is reachable from "), F.array_join(F.slice("sources", 1, 4), ", "), more, F.lit(". An audit of one device can't see a path across several.")).alias("summary"),
        F.slice(F.sort_array(F.array_distinct(F.concat(F.array("device_id"), F.transform("all", lambda p: host(p["source"]))))), 1, DEVICES).alias("devices"),
        F.slice("all", 1, PATHS).alias("paths"), F.when(F.col("inf"), "inferred").otherwise("asserted").alias("confidence"), F.col("device_id").alias("target"), fixes.alias("remediation"), cited.cast(EVIDENCE).alias("evidence"),
    )


def ntp_drift(docs: DataFrame) -> DataFrame:
    """One finding if some devices authenticate time and others don't: how many, and the first by name."""
    yes = F.coalesce("ntp.authenticated", F.lit(False))
    counts = docs.agg(F.count_if(yes).alias("n"), F.count_if(~yes).alias("without"))
    names = docs.where(~yes).select("device_id").orderBy("device_id").limit(DEVICES).agg(F.sort_array(F.collect_list("device_id")).alias("devices"))
    both = counts.where("n > 0 and without > 0").crossJoin(F.broadcast(names))  # one row each
    return both.select(
        F.lit("FLEET-NTP-DRIFT").alias("id"), F.lit("high").alias("severity"), F.lit("Time is authenticated on some devices only").alias("title"),
        F.concat(F.col("n").cast("string"), F.lit(" devices authenticate NTP and "), F.col("without").cast("string"), F.lit(" don't, so their clocks, and logs, can be told apart by nobody.")).alias("summary"), "devices",
        F.array(F.lit("Authenticate NTP on every device (CIS-NET-4.1.1)")).alias("remediation"), F.transform("devices", lambda d: F.struct(d.alias("device"), F.lit("ntp.authenticated").alias("ir_path"), F.lit("not authenticated").alias("detail"))).cast(EVIDENCE).alias("evidence"),
    )


def covers(a: Column, b: Column) -> Column:
    """Whether entry ``a`` matches everything that ``b`` matches; no address counts as any, and one that can't be
    read is covered by nothing."""
    early, late = F.coalesce(F.lower(a["protocol"]), F.lit("")), F.coalesce(F.lower(b["protocol"]), F.lit(""))
    out = (early.isin("ip", "any") | (early == late)) & (a["dst_port"].isNull() | a["dst_port"].eqNullSafe(b["dst_port"]))
    for f in ("src", "dst"):
        x, y = F.coalesce(a[f], F.lit("any")), F.coalesce(b[f], F.lit("any"))
        net = lambda t: F.when(t == "any", "0.0.0.0/0").otherwise(t)
        one = lambda t: F.when(~F.contains(net(t), F.lit("/")), F.when(F.contains(t, F.lit(":")), 128).otherwise(32))
        n = lambda t: F.coalesce(F.split_part(net(t), F.lit("/"), F.lit(2)).try_cast("int"), one(t))
        ip = lambda t: address_digits(F.split_part(net(t), F.lit("/"), F.lit(1)))
        inside = (F.length(ip(x)) == F.length(ip(y))) & (n(x) <= n(y)) & (leading_bits(ip(x), n(x)) == leading_bits(ip(y), n(x)))
        readable = n(y).isNotNull() & ip(y).isNotNull()
        out = out & (((x == "any") & readable) | F.coalesce(inside, F.lit(False)))
    return out


@per_session
def _covering() -> Column:
    """The first earlier entry of ``e`` that covers ``late``."""
    return F.get(F.filter(F.slice("e", F.lit(1), F.col("k")), lambda x: covers(x, F.col("late"))), F.lit(0))


def shadows(docs: DataFrame) -> DataFrame:
    """Entries that never fire: for each the first earlier one that covers it, found inside the array."""
    rows = docs.select("device_id", F.explode("acls").alias("a")).select("device_id", F.col("a.name").alias("acl"), F.col("a.entries").alias("e"), F.posexplode("a.entries").alias("k", "late"))
    hit = rows.withColumn("early", _covering()).where("early is not null")
    number = lambda c: F.col(f"{c}.seq").cast("string")
    same = F.col("early.action") == F.col("late.action")
    return hit.select(
        F.concat_ws("-", F.lit("FLEET-SHADOW"), "device_id", "acl", number("late")).alias("id"), F.when(same, "medium").otherwise("high").alias("severity"),
        F.concat(F.lit("ACL "), F.col("acl"), F.lit(" entry "), number("late"), F.lit(" on "), F.col("device_id"), F.lit(" never fires")).alias("title"),
        F.concat(F.lit("Entry "), number("early"), F.lit(" ("), "early.raw", F.lit(") takes everything that entry "), number("late"), F.lit(" ("), "late.raw", F.lit(") would"), F.when(same, ".").otherwise(", and does the opposite.")).alias("summary"), F.array("device_id").alias("devices"), F.col("early.seq").alias("covered_by"),
        F.array(F.concat(F.lit("Move entry "), number("late"), F.lit(" of "), "acl", F.lit(" before entry "), number("early"), F.lit(", or remove it"))).alias("remediation"),
        F.array(F.struct(F.col("device_id").alias("device"), F.lit("acls[]").alias("ir_path"), F.col("late.raw").alias("detail"))).cast(EVIDENCE).alias("evidence"),
    )


def reuse(docs: DataFrame) -> DataFrame:
    """A finding per credential that two or more accounts hold."""
    n = F.col("n_accounts").cast("string")
    return credentials(docs).select(
        F.concat(F.lit("FLEET-CREDENTIAL-"), F.left("fingerprint", F.lit(8))).alias("id"), F.lit("high").alias("severity"), F.concat(F.lit("The same credential is configured on "), F.col("n_devices").cast("string"), F.lit(" devices")).alias("title"),
        F.concat(n, F.lit(" accounts hold one secret: who has it has all of them.")).alias("summary"), "devices", F.array(F.lit("Give each device a credential of its own, or move accounts to central AAA (CIS-NET-5.1.1)")).alias("remediation"),
        F.transform("accounts", lambda a: F.struct(F.split_part(a, F.lit(":"), F.lit(1)).alias("device"), F.lit("aaa.local_users[]").alias("ir_path"), a.alias("detail"))).cast(EVIDENCE).alias("evidence"),
    )


def correlations(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """All findings across devices, worst first.

    Each kind is staged before they are united and sorted: the sort samples its input, which would work all
    of it out twice.
    """
    held = graph(docs) if held is None else held
    kinds = {"exposures": exposures(docs, held), "drift": ntp_drift(docs), "reuse": reuse(docs), "shadows": shadows(docs).drop("covered_by")}
    out = reduce(lambda a, b: a.unionByName(b, True), [staged(df, name) for name, df in kinds.items()])
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return out.orderBy(order, "id")


def rank(found: DataFrame) -> DataFrame:
    """Actions ordered by what they cut: fix, action, severity, rule_id, devices, paths_severed, correlations,
    score.

    An exposure is mended at its target, which cuts all its paths, or at an entry, which cuts one of each.
    """
    exposed = found.where("id like 'FLEET-EXPOSURE%'")
    after = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    host = F.split_part("p.source", F.lit(":"), F.lit(1))
    targets = exposed.select(F.concat(F.lit("mgmt-acl:"), "target").alias("fix"), F.concat(F.lit("Apply a management access list on "), "target").alias("action"), F.lit("critical").alias("severity"), F.lit("CIS-NET-1.4.1").alias("rule_id"), F.array("target").alias("devices"), F.size("paths").alias("cut"), "id")
    filters = exposed.select("id", F.explode("paths").alias("p")).select(F.concat(F.lit("filter:"), "p.source").alias("fix"), F.concat(F.lit("Filter management traffic inbound on "), after(F.col("p.source")), F.lit(" of "), host).alias("action"), F.lit("high").alias("severity"), F.lit("CIS-NET-6.1.1").alias("rule_id"), F.array(host).alias("devices"), F.lit(1).alias("cut"), "id")
    rule = F.when(F.startswith("id", F.lit("FLEET-CREDENTIAL")), "CIS-NET-5.1.1").when(F.col("id") == "FLEET-NTP-DRIFT", "CIS-NET-4.1.1")
    others = found.where("id not like 'FLEET-EXPOSURE%'").select(F.col("id").alias("fix"), F.coalesce(F.get("remediation", F.lit(0)), "title").alias("action"), "severity", rule.alias("rule_id"), "devices", F.lit(0).alias("cut"), "id")
    weight = F.lit(1)
    for k, v in WEIGHT.items():
        weight = F.when(F.col("severity") == k, v).otherwise(weight)
    sums = targets.unionByName(filters).unionByName(others).groupBy("fix", "severity").agg(
        F.first("action", True).alias("action"), F.first("rule_id", True).alias("rule_id"), F.first("devices", True).alias("devices"), F.sum("cut").cast("int").alias("paths_severed"), F.sort_array(F.collect_set("id")).alias("correlations")
    )
    return sums.withColumn("score", F.col("paths_severed") * 10 + weight).orderBy(F.col("score").desc(), "fix")


def headline(found: DataFrame) -> DataFrame:
    """One row: counts by severity, paths, and the sentence that says what one fix would cut."""
    sums = found.agg(F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in WEIGHT), F.coalesce(F.sum(F.size(F.coalesce("paths", F.array().cast(found.schema["paths"].dataType)))), F.lit(0)).alias("attack_paths"))
    top = rank(found).limit(1).agg(F.max("action").alias("action"), F.coalesce(F.max("paths_severed"), F.lit(0)).alias("cut"))
    n = F.col("findings").cast("string")
    text = (
        F.when(F.col("findings") == 0, "No exposure across devices was found.")
        .when(F.col("cut") > 1, F.concat(n, F.lit(" findings across devices over "), F.col("attack_paths").cast("string"), F.lit(" attack paths. One fix - "), "action", F.lit(" - cuts "), F.col("cut").cast("string"), F.lit(" of them.")))
        .otherwise(F.concat(n, F.lit(" findings across devices that no audit of one device can see.")))
    )
    return sums.crossJoin(F.broadcast(top)).withColumn("headline", text).drop("action", "cut")


def report(found: DataFrame) -> DataFrame:
    """One row: the fleet's report as text: a page of 200 findings and one of 200 fixes, and how many more there are
    (all findings are in the table itself)."""
    line = F.concat(F.lit("- **"), "severity", F.lit("** "), "id", F.lit(": "), "title", F.lit("\n  "), F.coalesce("summary", F.lit("")), F.lit("\n  "), F.array_join(F.coalesce("remediation", F.array().cast("array<string>")), "; "))
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    many = lambda df, name: df.agg(F.count("*").alias(name))
    more = lambda name: F.when(F.col(name) > 200, F.concat((F.col(name) - 200).cast("string"), F.lit(" more are not shown here.")))
    page = lambda df, by, c, name: df.orderBy(*by).limit(200).agg(F.transform(F.array_sort(F.collect_list(F.struct(*by_cols(by), c.alias("t")))), lambda x: x["t"]).alias(name))
    by_cols = lambda by: [b.alias(f"k{k}") for k, b in enumerate(by)]
    lines = page(found, [order, F.col("id")], line, "lines")
    fix = F.concat(F.lit("1. "), "action", F.lit(" (cuts "), F.col("paths_severed").cast("string"), F.lit(" paths)"))
    ranked = rank(found)
    fixes = page(ranked.withColumn("down", -F.col("score")), [F.col("down"), F.col("fix")], fix, "fixes")
    body = F.concat_ws("\n\n", F.lit("# Fleet"), "headline", F.lit("## Findings"), F.array_join("lines", "\n"), more("n_lines"), F.lit("## Fixes"), F.array_join("fixes", "\n"), more("n_fixes"))
    counts = many(found, "n_lines").crossJoin(many(ranked, "n_fixes"))
    return headline(found).crossJoin(F.broadcast(lines)).crossJoin(F.broadcast(fixes)).crossJoin(F.broadcast(counts)).select(body.alias("report"))
