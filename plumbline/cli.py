"""Command line: audit, fleet, show, rules, keygen, verify, drift, stig-import, propose, train, pack, trust, validate,
tier2-eval."""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    """A session; noting the Python line of every column would cost more than a small fleet's audit."""
    return SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()


def _documents(path: str) -> list[tuple[str, object]]:
    """Parsed JSON or YAML files: one, or those below a folder."""
    names = sorted(n for kind in ("yaml", "yml", "json") for n in glob.glob(f"{path}/**/*.{kind}", recursive=True)) if os.path.isdir(path) else [path]
    out = []
    for name in names:
        with open(name, encoding="utf-8") as file:
            if name.endswith(".json"):
                out.append((name, json.load(file)))
                continue
            try:
                import yaml
            except ImportError as e:
                raise SystemExit("reading YAML files needs PyYAML; JSON files are read without it") from e
            out.append((name, yaml.safe_load(file)))
    return out


def _rules(path: str | None):
    from plumbline.plans import rules

    return rules.SHIPPED if path is None else rules.from_documents(_documents(path))


def _trusted(path: str) -> set[str]:
    return set(json.load(open(path, encoding="utf-8"))) if os.path.exists(path) else set()


def _packs(path: str | None, store: str, keys: str | None = None):
    from plumbline.functions.ed25519 import trusted_keys
    from plumbline.operators import packs

    held = None if keys is None else trusted_keys(keys)
    return packs.admit([packs.from_document(d) for _, d in _documents(path)], _trusted(store), held) if path else None  # type: ignore[arg-type]


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="plumbline")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, **options: dict) -> None:
        c = commands.add_parser(name)
        for p in places:
            c.add_argument(p)
        for o, more in options.items():
            c.add_argument(f"--{o}", **more)

    text: dict = {}
    learned = {"packs": text, "trusted": {"default": "trusted.json"}, "keys": text}
    for name in ("audit", "fleet", "show"):
        command(name, "target", rules=text, framework=text, out=text, all={"action": "store_true"}, **learned)
    command("rules", rules=text)
    command("keygen", "file")
    command("verify", "ledger", key=text)
    command("drift", "before", "after")
    command("stig-import", "benchmark", bindings=text, rules=text, out=text)
    command("propose", "target", **learned)
    command("train", "target", vendor={"required": True}, os=text, id={"required": True}, out={"required": True}, least={"type": float, "default": 0.85})
    command("pack", "file", sign=text, out=text)
    command("trust", "file", trusted={"default": "trusted.json"})
    command("validate", "target", "labels", rules=text, **learned)
    command("tier2-eval", "target", "vendor")
    return parser


def main(arguments: list[str] | None = None) -> int:
    args = _parser().parse_args(arguments)

    from plumbline.functions import ed25519
    from plumbline.operators import packs
    from plumbline.sources.tables import scope

    if args.command == "rules":
        for r in _rules(args.rules):
            print(r.id, r.severity, r.assertion, sep="\t")
        return 0
    if args.command == "keygen":
        key = ed25519.SigningKey.generate()
        key.save(args.file)
        print(key.key_id)
        return 0
    if args.command in ("pack", "trust"):
        found = [packs.from_document(d) for _, d in _documents(args.file)]  # type: ignore[arg-type]
        for p in found:
            for m in p.mappings:
                m.check()
            print(p.id, p.vendor, p.os or "", len(p.mappings), p.digest(), sep="\t")
        if args.command == "pack" and args.sign:
            if len(found) != 1 or not args.out:
                raise SystemExit("one pack is signed at a time, into the file that --out names")
            with open(args.out, "w", encoding="utf-8") as file:
                json.dump(packs.document(found[0].signed(ed25519.SigningKey.load(args.sign))), file, indent=1, ensure_ascii=False)
        if args.command == "trust":
            held = _trusted(args.trusted) | {p.digest() for p in found}
            with open(args.trusted, "w", encoding="utf-8") as file:
                json.dump(sorted(held), file, indent=1)
        return 0
    spark = _session()
    with scope(spark):  # lines with secrets in clear are staged: none stays, whatever the command
        return _on_tables(args, spark)


def _on_tables(args: argparse.Namespace, spark: SparkSession) -> int:
    """The commands that need a session."""
    from plumbline.functions import ed25519
    from plumbline.operators import documents, drift, fleet, learning, ledger, packs, report, validation
    from plumbline.plans import audit, rules
    from plumbline.sources import benchmarks, xccdf
    from plumbline.sources.tables import staged

    if args.command == "verify":
        public = ed25519.load_public(args.key) if args.key else None
        problems = ledger.verify(ledger.read(spark, args.ledger), {ed25519.key_id(public): public} if public else None).orderBy("seq").collect()
        for p in problems:
            print(f"entry {p.seq}: {p.problem}")
        return int(bool(problems))
    if args.command == "stig-import" and os.path.isdir(args.benchmark):  # every benchmark of a folder
        bound = [b for _, d in _documents(args.bindings) for b in xccdf.bindings(d)] if args.bindings else []
        parsed = staged(benchmarks.parse(benchmarks.files(spark, args.benchmark)), "benchmarks")
        made = benchmarks.bind(parsed, bound, _rules(args.rules))
        benchmarks.counts(made).orderBy("file", "severity").show(1000, False)
        bad = parsed.where("error is not null").select("file", "error").collect()  # one row of a bad file
        for r in bad:
            print(f"{r.file}: {r.error}")
        if args.out:
            benchmarks.write(made, args.out)
        return int(bool(bad))
    if args.command == "stig-import":
        rows = xccdf.controls(xccdf.text_of(args.benchmark))
        bound = [b for _, d in _documents(args.bindings) for b in xccdf.bindings(d)] if args.bindings else []
        made, manual = xccdf.bind(rows, bound, _rules(args.rules))
        xccdf.counts(spark.createDataFrame(rows, xccdf.COLUMNS), [r[2] for r in rows if r not in manual]).show()
        if args.out:
            os.makedirs(args.out, exist_ok=True)
            for name, body in (("rules", rules.to_documents(made)), ("catalogue", xccdf.catalogue(rows, manual))):
                with open(f"{args.out}/{name}.json", "w", encoding="utf-8") as file:
                    json.dump(body, file, indent=1, ensure_ascii=False)
        return 0
    if args.command == "drift":
        # folders of written audits hold both documents and audits
        if os.path.isdir(f"{args.before}/audits") and os.path.isdir(f"{args.after}/audits"):
            a, b = (drift.written_verdicts(spark, f"{p}/audits") for p in (args.before, args.after))
            drift.same_devices(a, b)
            for r in drift.rules_changed(a, b).collect():
                print(f"{r.device_id}: the rules changed between the audits")
            drift.verdict_changes(a, b).show(200, False)
            return 0
        a, b = audit.audit(spark, args.before), audit.audit(spark, args.after)
        drift.same_devices(a.findings, b.findings)
        drift.verdict_changes(a.findings, b.findings).show(200, False)
        drift.fact_changes(a.facts, b.facts).show(200, False)
        return 0
    if args.command == "tier2-eval":
        warm, cold = audit.audit(spark, args.target), audit.audit(spark, args.target, hold_out=(args.vendor,))
        truth = warm.facts.where("path is not null and entity is null").join(warm.devices.where(f"vendor = '{args.vendor}'").select("device_id"), "device_id")
        rest = documents.residue(packs.tree(cold.lines), cold.facts).join(warm.devices.where(f"vendor = '{args.vendor}'").select("device_id"), "device_id")
        learning.held_out(learning.propose(rest), truth.select("device_id", "file", "line_no", "path", "value")).show(1, False)
        return 0
    if args.command in ("propose", "train"):
        result = audit.audit(spark, args.target, learned=_packs(args.packs, args.trusted, args.keys) if args.command == "propose" else None)
        found = learning.propose(documents.residue(packs.tree(result.lines), result.facts))
        if args.command == "propose":
            found.orderBy("device_id", "file", "line_no").show(500, False)
            return 0
        made = []
        for m in learning.mappings(learning.accepted(found, args.least)):
            try:
                m.check()
                made.append(m)
            except packs.PackError as e:
                print(f"left out {m.path}: {e}", file=sys.stderr)
        pack = packs.Pack(args.id, args.vendor, args.os, tuple(made), learning.fingerprint(made))
        with open(args.out, "w", encoding="utf-8") as file:
            json.dump(packs.document(pack), file, indent=1, ensure_ascii=False)
        print(pack.id, len(made), pack.digest(), sep="\t")
        return 0
    chosen = _rules(args.rules)
    framework = getattr(args, "framework", None)
    result = audit.audit(spark, args.target, ruleset=rules.for_framework(chosen, framework) if framework else chosen, learned=_packs(args.packs, args.trusted, args.keys))
    if args.command == "validate":
        facts, verdicts = validation.labels_of(_documents(args.labels))
        validation.verdicts(result.findings, spark.createDataFrame(verdicts, validation.VERDICT_LABEL)).show(1, False)
        validation.fact_accuracy(result.facts, spark.createDataFrame(facts, validation.FACT_LABEL)).show(1, False)
        validation.mean_coverage(result.coverage).show()
        return 0
    if args.command == "show":
        result.documents.show(50, False, True)
        return 0
    if args.command == "fleet":
        found = result.correlations()
        print(fleet.headline(found).first().headline)
        found.select("severity", "id", "title").show(100, False)
        fleet.rank(found).limit(6).select("score", "action").show(6, False)
        return 0
    result.summary().show(200, False)
    report.listing(rules.ordered(result.findings), args.all).select("device_id", "severity", "rule_id", "verdict", "title").show(500, False)
    if args.out:
        audit.write(result, args.out)
    return result.exit_code()


if __name__ == "__main__":
    sys.exit(main())
