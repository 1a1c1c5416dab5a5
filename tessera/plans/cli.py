"""The programs of the evidence pipeline: ``python -m tessera.plans.cli STAGE --base DIR ...``.

Stages read and write Parquet tables below ``--base``, partitioned by insurer,
and replace what an earlier run left for the same insurers. Inputs are
``scope/``, ``dictionary/`` and ``page_text/`` there (or CSV and JSON lines, loaded by ``load``).
Each stage is recorded by insurer in ``load_checkpoints/`` (see ``steps``); with
``--resume``, and in the stage ``run``, which does all that it has the options
for, what is complete for the same input is not done again.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import sizes, variants
from ..operators import cards, compare, gates, mapping, report, scope, search, slots
from ..sources import files, sinks
from . import steps

MOST_INSURERS = 10_000  # of a run: each has a partition, a checkpoint and a report of its own


class Base:
    """Tables below a folder."""

    def __init__(self, spark: SparkSession, path: str, insurers: list[str] | None = None, resume: bool = False) -> None:
        self.spark, self.path, self.insurers, self.resume = spark, path.rstrip("/"), insurers, resume

    def of(self, insurers: list[str]) -> Base:
        return Base(self.spark, self.path, insurers, self.resume)

    def listed(self) -> list[str]:
        """The insurers of this run: those that were named, or all that have a scope."""
        if self.insurers:
            return self.insurers
        found = [r.insurer for r in self.read("scope").select("insurer").distinct().orderBy("insurer").limit(MOST_INSURERS + 1).collect()]
        if len(found) > MOST_INSURERS:
            raise ValueError(f"more than {MOST_INSURERS} insurers; name those of a run")
        return found

    def step(self, name: str, inputs: list[str] | Callable[[str], list[str]], work: Callable[[Base], dict[str, int]], options: object = None, insurers: list[str] | None = None) -> list[str]:
        """Runs a recorded step; ``inputs`` are tables, or give an insurer's paths."""
        paths = inputs if callable(inputs) else lambda i: steps.table_paths(self.path, inputs, i)
        marks = {i: steps.fingerprint(self.spark, paths(i), options) for i in insurers or self.listed()}
        return steps.run(self.spark, f"{self.path}/load_checkpoints", name, marks, lambda todo: work(self.of(todo)), self.resume)

    def put(self, frame: DataFrame, name: str) -> dict[str, int]:
        """Replaces the partitions of this run's insurers; their rows."""
        return steps.written(frame, f"{self.path}/{name}", self.insurers)

    def read(self, name: str) -> DataFrame:
        rows = files.table(self.spark, f"{self.path}/{name}")
        return rows.where(F.col("insurer").isin(self.insurers)) if self.insurers and "insurer" in rows.columns else rows

    def write(self, frame: DataFrame, name: str, insurer: str | None = None) -> None:
        """Replaces the partitions of the insurers, or of one; an insurer without rows has none afterwards."""
        every = [insurer] if insurer else self.insurers or []
        sinks.replace_partitions(frame, f"{self.path}/{name}", ["insurer"], [{"insurer": i} for i in every])

    def extract(self, manifest_csv: str, reader: Callable[[bytes], list[str]]) -> None:
        """Scope names from the pages of each insurer's proposals (a manifest for each insurer), by the plain rules or, where they find too few, the hardened ones."""
        for insurer in self.insurers or []:
            pages = self.pages_of(manifest_csv.format(insurer=insurer), reader)
            by = ["insurer", "file_path", "page"]
            pages = pages.withColumn("insurer", F.lit(insurer))
            found = [scope.names_in_text(pages, by, rules).select(*by, "i", "name") for rules in (scope.PLAIN, scope.HARDENED)]
            plain, hardened = (scope.ordered_distinct(names, ["insurer", "name"], ["file_path", "page", "i"]) for names in found)
            names = scope.with_hardening(plain, hardened, ["insurer"]).withColumn("ord", F.col("page") * 1_000_000 + F.col("i"))
            self.write(names.select("insurer", "name", F.col("page").cast("string").alias("source_page"), "ord", "quality"), "scope", insurer)

    def pages(self, manifest_csv: str, reader: Callable[[bytes], list[str]]) -> None:
        """Page texts of the files in each insurer's manifest; files that cannot be read are rows of ``page_errors``."""
        for insurer in self.insurers or []:
            pages = self.pages_of(manifest_csv.format(insurer=insurer), reader).withColumn("insurer", F.lit(insurer))
            self.write(pages.where("status = 'success'").select("insurer", "doc_type", "file_path", "page", "text"), "page_text", insurer)
            self.write(pages.where("status <> 'success'").select("insurer", "doc_type", "file_path", "error"), "page_errors", insurer)

    def pages_of(self, manifest_csv: str, reader: Callable[[bytes], list[str]]) -> DataFrame:
        return files.extracted(files.csv(self.spark, manifest_csv, files.MANIFEST, ["doc_type", "file_path"]), reader)

    def load(self, scope_csv: str, dictionary_csv: str, pages: str) -> None:
        """Scope and page files of each insurer (``{insurer}`` stands for it in the paths), and the dictionary (CSV or XLSX)."""
        def union(make):
            return lambda part, name: part.put(reduce(DataFrame.unionByName, map(make, part.insurers)), name)

        def dictionary(part: Base) -> dict[str, int]:
            reader = files.xlsx if dictionary_csv.endswith(".xlsx") else files.csv
            rows = reader(self.spark, dictionary_csv, files.DICTIONARY).withColumnRenamed("ord", "row_no")
            seen = Observation()
            rows.select("coverage_code", "canonical", "alias", "row_no").observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/dictionary")
            return {steps.ALL: seen.get["n"]}

        scopes = union(lambda i: files.scope(self.spark, scope_csv.format(insurer=i)).withColumn("insurer", F.lit(i)))
        texts = union(lambda i: files.page_text(self.spark, pages.format(insurer=i), i))
        self.step("load_scope", lambda i: [scope_csv.format(insurer=i)], lambda part: scopes(part, "scope"))
        self.step("load_pages", lambda i: [pages.format(insurer=i)], lambda part: texts(part, "page_text"))
        self.step("load_dictionary", lambda _: [dictionary_csv], dictionary, insurers=[steps.ALL])

    def map(self) -> None:
        def work(part: Base) -> dict[str, int]:
            known = mapping.dictionary(files.table(self.spark, f"{self.path}/dictionary"))
            return part.put(mapping.mapped(part.read("scope"), known), "scope_mapped")

        self.step("map", ["scope", "dictionary*"], work)

    def search(self, rules: dict[str, str] | None = None, fallback: list[str] | None = None, definitions: list[tuple] | None = None) -> None:
        """``rules`` names a variant rule set for an insurer; ``fallback`` lists insurers with token search; ``definitions`` are (insurer, code, type)."""
        def work(part: Base) -> dict[str, int]:
            rows = scope.in_scope(part.read("scope_mapped"), part.read("scope"))
            rule = F.create_map(*[F.lit(x) for kv in (rules or {"": ""}).items() for x in kv])[F.col("insurer")]
            rows = rows.withColumn("keywords", variants.keywords(F.col("canonical"), F.col("name"), F.col("mapping_status") == "matched", F.coalesce(rule, F.lit(""))))
            few = self.spark.createDataFrame([(i,) for i in fallback or []], "insurer string") if fallback else None
            lines = self.spark.createDataFrame(definitions, "insurer string, coverage_code string, doc_type string") if definitions else None
            return part.put(search.packs(rows, part.read("page_text"), few, lines), "evidence_pack")

        self.step("search", ["scope_mapped", "scope", "page_text"], work, [rules, fallback, definitions])

    def cards(self) -> None:
        def work(part: Base) -> dict[str, int]:
            pack = scope.in_scope(part.read("evidence_pack"), part.read("scope"))
            return part.put(cards.built(scope.in_scope(part.read("scope_mapped"), part.read("scope")), pack), "coverage_cards")

        self.step("cards", ["evidence_pack", "scope", "scope_mapped"], work)

    def report(self) -> None:
        """A report of each insurer, all in one job; the row count is that of its lines."""
        def work(part: Base) -> dict[str, int]:
            lines = report.insurer_lines(part.read("coverage_cards"), part.read("evidence_pack"))
            return sinks.text_files(lines, f"{self.path}/reports", "insurer", list(report.LINE_ORDER), ".md")

        self.step("report", ["coverage_cards", "evidence_pack"], work)

    def compare(self, a: str, b: str) -> DataFrame:
        rows = self.read("coverage_cards")
        pairs = compare.pair(rows.where(F.col("insurer") == a), rows.where(F.col("insurer") == b), a, b)
        pairs.write.mode("overwrite").parquet(f"{self.path}/compare/{a}_{b}")
        sinks.pretty_json(compare.pair_stats(pairs), f"{self.path}/compare/{a}_{b}_stats.json")
        sinks.markdown(self.spark, report.pair_report(pairs, a, b), f"{self.path}/reports/{a}_{b}.md")
        return pairs

    def compare_all(self) -> None:
        rows = self.read("coverage_cards")
        compare.presence(rows, rows.select("insurer")).write.mode("overwrite").parquet(f"{self.path}/compare/all")
        sinks.markdown(self.spark, report.overview_report(rows), f"{self.path}/reports/all.md")

    def slots(self, code: str) -> DataFrame:
        """The slot profile of a code for each insurer."""
        def work(part: Base) -> dict[str, int]:
            pack = part.read("evidence_pack").where(F.col("coverage_code") == code)
            first = pack.groupBy("insurer").agg(F.min_by("evidences", "ord").alias("evidences"))
            rows = first.select("insurer", F.posexplode("evidences").alias("ord", "e")).select("insurer", "ord", "e.*")
            return part.put(slots.profiles(rows, ["insurer"]).withColumn("coverage_code", F.lit(code)), f"slots/{code}")

        self.step(f"slots {code}", ["evidence_pack"], work)
        return self.read(f"slots/{code}")

    def profile(self, code: str, insurers: list[str]) -> tuple[DataFrame, DataFrame]:
        """The stored slots of a code for some insurers, and their hits by document type; without any of them an error."""
        stored = files.table(self.spark, f"{self.path}/slots/{code}", insurer=insurers)
        missing = set(insurers) - {r.insurer for r in stored.select("insurer").distinct().collect()}
        if missing:
            raise ValueError(f"no slots of {code} for {sorted(missing)}")
        pack = files.table(self.spark, f"{self.path}/evidence_pack", insurer=insurers, coverage_code=code)
        return stored, slots.hits_by_type(pack, search.TYPES)

    def slot_pair(self, a: str, b: str, code: str) -> DataFrame:
        """Two insurers' slots of a code, as a document and a report."""
        stored, hits = self.profile(code, [a, b])
        place = f"{self.path}/slots/{a}_vs_{b}_{code}_compare.json"
        sinks.pretty_json(slots.document(stored, hits, code, [a, b]), place)
        sinks.markdown(self.spark, report.slot_pair_report(stored, code, a, b), f"{self.path}/reports/{a}_vs_{b}_{code}.md")
        return slots.compared(stored, [a, b])

    def slot_all(self, code: str, name: str = "") -> DataFrame:
        """All insurers' slots of a code, as a document and a report, and what is unknown or without hits."""
        found = files.table(self.spark, f"{self.path}/slots/{code}").select("insurer").distinct().orderBy("insurer").limit(MOST_INSURERS).collect()
        insurers = [r.insurer for r in found]
        stored, hits = self.profile(code, insurers)
        sinks.pretty_json(slots.document(stored, hits, code, insurers), f"{self.path}/slots/{code}_all_compare.json")
        sinks.markdown(self.spark, report.slot_report(stored, code, name, insurers, hits), f"{self.path}/reports/{code}_all_insurers.md")
        return slots.without_hits(hits, search.TYPES)

    def gate(self, code: str, as_of_date: str, ins_cds: list[str]) -> None:
        """Slot rows of a code and date for some insurers, and the payload; both tables' partition (code, date) is replaced as a whole."""
        key = {"coverage_code": code, "as_of_date": as_of_date}
        chunks = files.table(self.spark, f"{self.path}/coverage_chunk", **key, ins_cd=ins_cds)
        ssot = files.table(self.spark, f"{self.path}/coverage_mapping_ssot", coverage_code=code)
        found = gates.slot_rows(chunks, ssot, code).withColumns({k: F.lit(v) for k, v in key.items()})
        found = sizes.known(found)  # a row for each insurer and slot
        sinks.replace_partitions(found, f"{self.path}/evidence_slot", list(key), [key])
        sinks.insert_payload(gates.payload(found).withColumns({k: F.lit(v) for k, v in key.items()}), f"{self.path}/compare_table_v2", list(key), [key])
        if not found.limit(1).count():
            raise ValueError(f"no slot was found for {code} at {as_of_date}")


    def run(self, code: str | None = None, name: str = "", scope_csv: str | None = None, dictionary_csv: str | None = None, pages: str | None = None, **options) -> None:
        """All stages in order, without what is complete: load where its files are named, slots where a code is."""
        part = Base(self.spark, self.path, self.insurers, True)
        if scope_csv and dictionary_csv and pages:
            part.load(scope_csv, dictionary_csv, pages)
        part.map()
        part.search(**options)
        part.cards()
        part.report()
        part.compare_all()
        if code:
            part.slots(code)
            part.slot_all(code, name)


STAGES = ("extract", "pages", "load", "map", "search", "cards", "report", "compare", "compare_all", "slots", "slot_pair", "slot_all", "gate", "run")


def run(spark: SparkSession, stage: str, base: str, insurers: list[str] | None = None, resume: bool = False, **options):
    return getattr(Base(spark, base, insurers, resume), stage)(**options)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("--base", required=True)
    parser.add_argument("--insurer", action="append")
    parser.add_argument("--resume", action="store_true", help="leave out what is complete for the same input")
    for name in ("a", "b", "code", "name", "as-of-date"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--ins-cds", nargs="*")
    parser.add_argument("--manifest-csv", help="of extract and pages; {insurer} stands for the insurer")
    parser.add_argument("--reader", help="of extract and pages: module:function from a file's bytes (or, if it has the attribute streams, the open file) to page texts")
    parser.add_argument("--scope-csv", help="of load and run; {insurer} stands for the insurer")
    parser.add_argument("--dictionary-csv", help="of load and run; a CSV or XLSX file")
    parser.add_argument("--pages", help="of load and run: an insurer's folder of page files")
    parser.add_argument("--rules", action="append", metavar="INSURER=SET", help="of search and run: a variant rule set of an insurer")
    parser.add_argument("--fallback", action="append", metavar="INSURER", help="of search and run: token search where nothing is found")
    parser.add_argument("--definitions", action="append", metavar="INSURER:CODE:TYPE", help="of search and run: look for a definition line")
    args = parser.parse_args(argv)
    if args.reader:
        module, name = args.reader.split(":")
        args.reader = getattr(importlib.import_module(module), name)
    if args.rules:
        args.rules = dict(x.split("=", 1) for x in args.rules)
    if args.definitions:
        args.definitions = [tuple(x.split(":", 2)) for x in args.definitions]
    options = {k: v for k, v in vars(args).items() if k not in ("stage", "base", "insurer", "resume") and v is not None}
    run(SparkSession.builder.getOrCreate(), args.stage, args.base, args.insurer, args.resume, **options)


if __name__ == "__main__":
    main()
