from __future__ import annotations

import random
from collections import deque

from pyspark.sql import functions as F

from plumbline.operators import fleet

MEMBERS = "device_id string, place int, n int, name string, segment string, inferred boolean, trust string, shutdown boolean, entries array<struct<action:string,protocol:string,dst_port:string>>"
DENY_SSH = [("deny", "tcp", "eq 22"), ("permit", "ip", None)]


def by_queue(rows, start, port):
    """Arrivals of one sweep with a queue, one step at a time."""
    rows = sorted((r for r in rows if not r[7]), key=lambda r: r[:3])
    got, known, queue = {}, {start}, deque([(start, [start], False, 0)])
    while queue:
        segment, hops, guessed, depth = queue.popleft()
        if depth == fleet.HOPS:
            continue
        for device, place, _, name, _, inferred, _, _, entries in (r for r in rows if r[4] == segment):
            if entries and port == 22:
                continue
            here = guessed or inferred
            got.setdefault(device, (name, [*hops, f"{device}:{name}"], here, depth))
            for other in rows:
                if other[0] == device and other[1] != place and other[4] not in known:
                    known.add(other[4])
                    queue.append((other[4], [*hops, f"{device}:{other[3]}", other[4]], here or other[5], depth + 1))
    return got


def fleet_of(rng, devices, segments):
    rows = []
    for d in range(devices):
        for place in range(rng.randint(1, 4)):
            inferred, down, trust = rng.random() < 0.3, rng.random() < 0.1, rng.choice(["untrusted", "internal", "internal"])
            acl = rng.choice([None, None, DENY_SSH])
            for n, s in enumerate(rng.sample(range(segments), rng.choice([1, 1, 2]))):
                rows.append((f"d{d}", place, n, f"if{place}", f"s{s}", inferred, trust, down, acl))
    return rows


def test_sweeps_like_a_queue(spark):
    rng = random.Random(3)
    rows, at = [], []
    for k, (devices, segments) in enumerate([(14, 9), (30, 25), (40, 60), (3, 2)]):  # separate fleets in one table
        own = [(f"{k}{r[0]}", *r[1:4], f"{k}{r[4]}", *r[5:]) for r in fleet_of(rng, devices, segments)]
        rows += own
        at += own
    chain = [(f"c{k}", p, 0, f"if{p}", f"chain{k + p}", False, "untrusted" if k == p == 0 else "internal", False, None) for k in range(9) for p in (0, 1)]
    rows += chain
    df = spark.createDataFrame(rows, MEMBERS)
    got = {(r.start, r.port, r.device_id): (r.interface, list(r.hops), r.inferred, r.depth) for r in fleet.sweeps(df).collect()}
    starts = {r[4] for r in rows if r[6] == "untrusted" and not r[7]}
    want = {(s, p, d): x for s in starts for _, p in fleet.SERVICES.values() for d, x in by_queue(rows, s, p).items()}
    assert got == want and max(x[3] for x in want.values()) == fleet.HOPS - 1
    assert len({x[3] for x in want.values()}) == fleet.HOPS


def test_sweeps_of_nothing(spark):
    assert fleet.sweeps(spark.createDataFrame([], MEMBERS)).count() == 0
    lonely = spark.createDataFrame([("d", 0, 0, "a", "s", False, "untrusted", True, None), ("e", 0, 0, "b", "t", False, "internal", False, None)], MEMBERS)
    assert fleet.sweeps(lonely).count() == 0


def test_sweeps_go_over_segments(spark):
    """Many devices between two segments are one link for each set of ports, however many there are."""
    rows = [(f"d{k:03}", p, 0, f"if{p}", f"s{p}", False, "internal", False, DENY_SSH if k % 2 else None) for k in range(200) for p in (0, 1)]
    m = spark.createDataFrame(rows, MEMBERS).withColumn("inf", F.col("inferred")).withColumn("ports", fleet._open_ports())
    found = {(r.port, r.segment, r.to): (r.x.device_id, r.x.place, r.x.out) for r in fleet.links(m).collect()}
    ports = [p for _, p in fleet.SERVICES.values()]
    assert found == {(p, a, b): ("d000", int(a[1]), int(b[1])) for p in ports for a, b in (("s0", "s1"), ("s1", "s0"))}


def test_bare_addresses_meet_declared_lengths_only(spark):
    """A bare address joins the first network that holds it, and is looked up at no other lengths."""
    body = "array(named_struct('name', 'a', 'description', CAST(NULL AS STRING), 'addresses', array({}), 'acl_in', CAST(NULL AS STRING), 'zone', CAST(NULL AS STRING), 'shutdown', false, 'is_mgmt', false))"
    rows = ["'10.0.0.1/20'", "'10.0.0.2/24'", "'10.0.1.7'", "'10.0.0.7', '192.0.2.9'", "'2001:db8::5'", "'10.0.1.7'"]
    acls = "CAST(array() AS array<struct<name:string,entries:array<struct<action:string,protocol:string,dst_port:string>>>>)"
    docs = spark.sql(" UNION ALL ".join(f"SELECT 'd{k}' AS device_id, {body.format(r)} AS interfaces, {acls} AS acls" for k, r in enumerate(rows)))
    got = {(r.device_id, r.n): (r.segment, r.inferred) for r in fleet.members(docs).collect()}
    assert got == {("d0", 0): ("10.0.0.0/20", False), ("d1", 0): ("10.0.0.0/24", False), ("d2", 0): ("10.0.0.0/20", True), ("d3", 0): ("10.0.0.0/20", True), ("d3", 1): ("192.0.2.0/24", True), ("d4", 0): ("2001:db8::/64", True), ("d5", 0): ("10.0.0.0/20", True)}
    made = [x for x in fleet.members(docs)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(sequence" in x]
    assert not made
