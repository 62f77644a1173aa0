"""The catalogue engine: commands over versioned tables.

Every command reads one version of the store, computes its tables with the
operators of this package and commits all of them at once on that version; a
failing guard, an error in between or another writer's commit leaves nothing
behind.  Rows of a load are append-only; gold tables are replaced.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.operators import checks, classify, codes, duplicates, inventory, labels, links, profile, publication, search, sites, wordindex
from acervo.operators.numbering import dense_ids
from acervo.rulepack import RulePack
from acervo.session import cut, tidy, together
from acervo.sources.buckets import Buckets
from acervo.sources.store import Store, Written, empty

#: Headers of the source's sheet, their columns here, and the values that enumerations and flags may have.
HEADERS = {
    "Product ID": "code", "Description": "description", "Type": "product_type", "ITEMCATEGORY": "category", "Package": "package", "MANUFACTURER": "brand", "MODEL": "model", "SITEID": "site", "SITENAME": "site_name",
    "Stock": "stock", "Cost": "cost", "Replacement Cost": "replacement_cost", "CostoTotal": "total_cost", "RETAILPRICE": "retail_price", "LOWRETAILPRICE": "low_retail_price", "MSRP": "msrp",
    "MAXIMUMQTY": "most", "MINIMUMQTY": "least", "REORDERQTY": "reorder", "CANRENT": "can_rent", "CANSELL": "can_sell", "CANSUBRENT": "can_subrent",
    "AFFECTSAVAILABILITY": "affects_availability", "ISFREIGHT": "is_freight", "ISMISCITEM": "is_misc_item", "Bin Loaction": "bin_location", "Shelf Location": "shelf_location",
    "Report Group": "label_a", "EXCHANGEGROUP": "label_b", "INVENTORYGROUP": "label_c", "DEPARTMENT": "label_d", "REVENUEGROUP": "label_e", "Availability Group": "label_f",
    "ACCUMULATEDDEPRECIATIONGLCODE": "label_g", "WRITEOFFGLCODE": "label_h", "COGSGROUP": "label_i", "TAXGROUP": "label_j", "DEPRCIATIONGLCODE": "label_k", "DISCOUNTGROUP": "label_l",
    "SUBRENTGLCODE": "label_m", "SELLGLCODE": "label_n", "Price Group": "label_o",
}
ENUMS = {"product_type": ("ITEM", "MISCCHARGE", "LABOR", "PARTS"), "package": ("ITEM", "PACKAGE"), "category": ("SERIAL", "NONSERIAL")}
FLAGS = {"can_rent": {"RENTABLE": 1, "NOTRENTABLE": 0}, "can_sell": {"SELLABLE": 1, "NOTSELLABLE": 0}, "can_subrent": {"SUBRENT": 1, "NOTSUBRENT": 0}}
PUBLISHED_FLAGS = {"affects_availability": {"TRUE": 1, "FALSE": 0}, "is_freight": {"FREIGHT": 1, "NOTFREIGHT": 0}, "is_misc_item": {"MISCITEM": 1, "NOTMISCITEM": 0}}

REQUIRED = ("code", "description", "site", "site_name")
IDENTITY = ("brand", "model")
ATTRIBUTES = ("description", "product_type", "package", "category", "brand", "model")
NUMBERS = ("stock", "cost", "replacement_cost", "total_cost", "retail_price", "low_retail_price", "msrp", "most", "least", "reorder")
LABELS = tuple(f"label_{c}" for c in "abcdefghijklmno")
EVIDENCE = LABELS[:3]
COLUMNS = ("row_number", "code", "description", "product_type", "package", "brand", "model", "site", "site_name", "stock", "label_a", "label_b")
MORE = ("category", *NUMBERS[1:], *FLAGS, *PUBLISHED_FLAGS, "bin_location", "shelf_location", *LABELS[2:])
ROWS = (*COLUMNS, *MORE)
MOST_ROWS, MOST_SITES = search.MOST_ROWS, 5000
MOST_CHANGES = 16  # folders of a bucket of the index after which it is written anew
WORDS_A_PRODUCT = 40  # postings, about: what the index's number of buckets is taken from
FEW_FOUND = 64  # products that a search fetches from their buckets alone

STANDARD = (
    "master_id long, load_id long, code string, standard_code string, name string, brand string, model string, category string, family string, product_type string, package string, method string, status string, duplicate_key string, "
    "countries array<string>, stock_by_country map<string,double>, stock double, sites_with_stock long, search_text string, legacy_codes array<string>, retired_codes array<string>, origin string, duplicate_group string, duplicate_kind string"
)
SHOWN = [c.split()[0] for c in STANDARD.split(", ")]
TABLES = {
    "loads": "load_id long, source string, key string, rows long, accepted long, missing array<string>, issues array<struct<severity: string, field: string, code: string>>, received_at string",
    "files": "source string, sha256 string, load_id long",
    "label_values": "source string, field string, value string, value_id long",
    "row_labels": "load_id long, row_number long, field string, value_id long",
    "masters": "source string, code string, master_id long, origin string",
    "sites": "source string, site string, site_name string, country string, country_source string, site_type string, type_source string",
    "brands": "brand_key string, brand string",
    "brand_aliases": "source string, brand_key string, spelling string",
    "links": "link_id long, source_id long, source_code string, target_id long, retired_code string, codes array<string>, undone boolean, actor string, reason string, at string",
    "reviews": "master_id long, decision string, reviewed_family string, actor string, reason string",
    "samples": "load_id long, family string, code string, original string",
    "decisions": "load_id long, row_number long, decision string, actor string, reason string",
    "publications": "source string, load_id long, snapshot_at string, date_basis string, actor string, reason string, published_at string",
    "manual_entries": "master_id long, site string, stock double, actor string, reason string",
    "requests": "request_id string, payload string, master_id long",
    "runs": "run_id long, load_id long, summary string",
    "audit": "entity string, entity_id string, action string, before string, after string, actor string, reason string, at string",
}


PROPOSAL = "load_id long, code string, family string, status string, reason string, lexical array<string>, labels array<string>"


class Rejected(ValueError):
    """A command's guard did not hold; nothing was written."""


class ExportLocked(RuntimeError):
    """The exported mart could not be replaced; the one before is still there."""


def digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def people(actor: str, reason: str) -> None:
    if not ((actor or "").strip() and (reason or "").strip()):
        raise Rejected("actor and reason are needed")


def tidied(command: Callable) -> Callable:
    """A command whose result holds no table: the intermediate ones go with it."""

    @wraps(command)
    def run(self, *args, **kwargs):
        with tidy(self.spark):
            return command(self, *args, **kwargs)

    return run


class Engine:
    def __init__(self, spark: SparkSession, root: str, pack: RulePack):
        self.spark, self.store, self.pack = spark, Store(spark, root), pack
        self.catalogue = Buckets(self.store, "standards", STANDARD, "master_id")
        self.decided = Buckets(self.store, "reviews", TABLES["reviews"], "master_id")
        self.words = Buckets(self.store, "words", wordindex.POSTING, "key", rows=20 * self.catalogue.rows)

    def table(self, name: str) -> DataFrame:
        if name in ("standards", "reviews"):
            return (self.catalogue if name == "standards" else self.decided).read()
        return self.store.read_or_empty(name, TABLES.get(name, STANDARD))

    def rows_as(self, name: str, rows: Sequence[tuple]) -> DataFrame:
        return self.spark.createDataFrame(list(rows), TABLES.get(name, STANDARD))

    def event(self, entity: str, key, action: str, before, after, actor: str, reason: str) -> DataFrame:
        text = lambda v: None if v is None else json.dumps(v, sort_keys=True, default=str, ensure_ascii=False)
        return self.rows_as("audit", [(entity, str(key), action, text(before), text(after), actor, reason, now())])

    def migrate(self, name: str, schema: str) -> None:
        """Bring a stored table to ``schema``: missing columns come as nulls, others are cast; its rows stay."""
        at = self.store.version()
        old, fields = self.store.read(name), self.spark.createDataFrame([], schema).schema.fields
        self.store.commit({name: old.select(*[(F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])}, f"migrate {name}", expected=at)

    # ------------------------------------------------------------ loads
    @tidied
    def stage(self, frame: DataFrame, source: str, key: str, files: DataFrame | None = None) -> dict:
        """Validate and append a file's rows, its labels and its load in one commit; the same (source, key) again changes nothing.

        Columns may have the sheet's headers or the names here; ``files`` lists the
        ``sha256`` of the files that the rows come from.
        """
        if not source.strip():
            raise Rejected("a source is needed")
        at = self.store.version()
        loads = self.table("loads")
        known = loads.where((F.col("source") == source) & (F.col("key") == key)).first()
        if known:
            return {**known.asDict(), "repeated": True}
        raw = frame.withColumnsRenamed({h: c for h, c in HEADERS.items() if h in frame.columns})
        missing = checks.missing_columns(raw.columns, REQUIRED)
        given = set(raw.columns)
        for c in ROWS:
            if c not in given:
                raw = raw.withColumn(c, F.lit("") if c != "row_number" else F.monotonically_increasing_id() + 2)
        load_id = (loads.agg(F.max("load_id")).first()[0] or 0) + 1
        staged = self.store.write("rows", self.validated(raw, bool(missing), given).withColumn("load_id", F.lit(load_id)).withColumn("source", F.lit(source)))
        n = staged.rows.agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "accepted").alias("accepted")).first()
        issues = checks.file_issues(sorted(given), REQUIRED, n.rows)
        load = (load_id, source, key, n.rows, n.accepted, missing, [{"severity": a, "field": b, "code": c} for a, b, c in issues], now())
        append: dict[str, DataFrame | Written] = {"rows": staged, "loads": self.rows_as("loads", [load])}
        report = {"rows": n.rows, "accepted": n.accepted, "missing": missing}
        append |= self.labelled(staged.rows, source, load_id) | {"audit": self.event("load", load_id, "stage", None, report, "importer", "staged, not published")}
        if files is not None:
            append["files"] = files.select(F.lit(source).alias("source"), "sha256", F.lit(load_id).cast("long").alias("load_id"))
        self.store.commit({}, f"stage {source}", expected=at, append=append)
        return {"load_id": load_id, "source": source, "key": key, **report, "repeated": False, "ready": not issues and n.rows == n.accepted}

    def labelled(self, rows: DataFrame, source: str, load_id: int) -> dict[str, DataFrame]:
        """The dictionary's new (field, value) pairs of the source, and the rows' links to it: values are stored once."""
        long = labels.unpivot_labels(rows.select("row_number", *LABELS), ["row_number"], LABELS)
        every = self.table("label_values")
        known = every.where(F.col("source") == source)
        top = every.agg(F.coalesce(F.max("value_id"), F.lit(0))).first()[0]
        dictionary, links = labels.encode(long, known, top)
        fresh = dictionary.join(known.select("field", "value"), ["field", "value"], "left_anti")
        return {
            "label_values": fresh.select(F.lit(source).alias("source"), "field", "value", "value_id"),
            "row_labels": links.select(F.lit(load_id).cast("long").alias("load_id"), F.col("row_number").cast("long").alias("row_number"), "field", "value_id"),
        }

    def validated(self, raw: DataFrame, missing: bool, given: set[str]) -> DataFrame:
        """Cleaned rows with their issues and status; set-level checks join only the violating keys back."""
        present = lambda rules: {c: v for c, v in rules.items() if c in given}
        flags = {c: tuple(v) for c, v in present(FLAGS).items()}
        found = checks.issues_of(raw.columns, required=REQUIRED, identity=IDENTITY, placeholders=self.pack.placeholders, enums={**{c: v for c, v in ENUMS.items() if c != "category"}, **({"category": ENUMS["category"]} if "category" in given else {})}, flags=flags, numbers=[c for c in NUMBERS if c in given or c == "stock"], zero_code="code")
        numbers = {c: T.decimal_text(F.col(c))["value"] for c in NUMBERS[1:]}
        clean = {c: F.nullif(T.clean(F.col(c)), F.lit("")) for c in ROWS if c not in ("row_number", *NUMBERS)}
        rows = raw.withColumn("issues", found).withColumn("amount", T.decimal_text(F.col("stock"))["value"].try_cast("double")).withColumns({**clean, **numbers}).select(*ROWS, "amount", "issues")
        twice = rows.groupBy("code", "site").count().where("count > 1").select(F.col("code").alias("_c"), F.col("site").alias("_s"), F.lit("duplicate_key").alias("_dup"))
        mixed = checks.conflicts(rows, "code", ATTRIBUTES).select(F.col("code").alias("_k"), F.lit("conflicting_identity").alias("_con")).distinct()
        names = checks.conflicts(rows, "site", ["site_name"]).select(F.col("site").alias("_t"), F.lit("conflicting_site").alias("_site")).distinct()
        joined = rows.join(twice, F.col("code").eqNullSafe(F.col("_c")) & F.col("site").eqNullSafe(F.col("_s")), "left").join(mixed, F.col("code") == F.col("_k"), "left").join(names, F.col("site") == F.col("_t"), "left")
        more = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit("error").alias("severity"), F.lit(f).alias("field"), F.col(c).alias("code"))) for c, f in (("_dup", "code + site"), ("_con", "code"), ("_site", "site_name"))]))
        issues = F.concat("issues", more)
        return joined.withColumn("issues", issues).withColumn("status", F.when(checks.quarantined(missing_columns=missing), "quarantined").otherwise("accepted")).select(*ROWS, "amount", "issues", "status")

    def rows_of(self, load_id: int) -> DataFrame:
        return self.store.read("rows").where(F.col("load_id") == load_id)

    def report(self, load_id: int) -> DataFrame:
        return checks.report(self.rows_of(load_id))

    def load(self, load_id: int):
        found = self.table("loads").where(F.col("load_id") == load_id).first()
        if found is None:
            raise Rejected("no such load")
        return found

    # ------------------------------------------------------------ conservative masters
    @tidied
    def build(self, load_id: int, history: DataFrame | None = None) -> dict:
        """A master for each code that is not quarantined, and a conservative review of each code; again, it changes nothing.

        ``history`` holds earlier proposals ``(code, field, value, version, step)`` of
        other tools; the newest of a code that waits is what it proposes.
        """
        at = self.store.version()
        rows = self.rows_of(load_id).where("code IS NOT NULL")
        source = self.load(load_id).source
        masters, done = self.table("masters"), self.proposals(load_id)
        own = masters.where(F.col("source") == source)
        products = cut(checks.product_rows(rows, "code", ["row_number"], ["description", "product_type", "package", *EVIDENCE], "row_number"), "products")
        base = T.normal_name(F.col("description"), self.pack)
        known = own.select("code", F.lit(True).alias("has_master"))
        seen = products.join(known, "code", "left").withColumns({"lexical": classify.families_of_name(base, self.pack), "found": classify.families_of_labels([F.col(c) for c in EVIDENCE], self.pack.label_aliases)})
        warning = F.col("description").rlike("(?iU)" + self.pack.flag_pattern)
        r = classify.review(F.col("quarantined"), F.col("lexical"), F.col("found"), F.col("package"), F.col("product_type"), warning, F.col("has_master"))
        fresh = seen.withColumn("r", r).select(F.lit(load_id).cast("long").alias("load_id"), "code", "r.family", "r.status", "r.reason", "lexical", F.col("found").alias("labels"))
        if history is not None:
            fresh = classify.with_history(fresh, history, "code", ["step"])
        fresh = self.store.write("proposals", fresh.join(done.select("code"), "code", "left_anti").select(*done.columns))
        made = self.store.write("masters", self.with_masters(products.where("NOT quarantined").select("code"), masters, source))
        n = (made.rows.count(), fresh.rows.count())
        states = {r.status: r["count"] for r in done.unionByName(fresh.rows).groupBy("status").count().collect()}
        if any(n):
            self.store.commit({}, f"build {load_id}", expected=at, append={f"proposals.{load_id}": fresh, "masters": made})
        return {"load_id": load_id, "codes": sum(states.values()), "status": states, "new_masters": n[0], "new_reviews": n[1]}

    def proposals(self, load_id: int) -> DataFrame:
        """The conservative reviews of a load: a table of their own for each load."""
        return self.store.read_or_empty(f"proposals.{load_id}", PROPOSAL)

    def with_masters(self, wanted: DataFrame, masters: DataFrame, source: str, origin: str = "import") -> DataFrame:
        """Master rows for codes that have none in their source, numbered on in order of the code; a code of another source is another product."""
        top = masters.agg(F.coalesce(F.max("master_id"), F.lit(0))).first()[0]
        new = wanted.distinct().join(masters.where(F.col("source") == source).select("code"), "code", "left_anti")
        return dense_ids(new, ["code"], "master_id", top).select(F.lit(source).alias("source"), "code", "master_id", F.lit(origin).alias("origin"))

    @tidied
    def freeze_sample(self, load_id: int) -> int:
        """The quality sample of a load, drawn once: up to five codes of each family that rules approved."""
        at = self.store.version()
        old = self.table("samples").where(F.col("load_id") == load_id)
        if old.isEmpty():
            rows = self.proposals(load_id).where(F.col("status") == classify.APPROVED)
            drawn = profile.stratified_sample(rows, "family", "code").select("load_id", "family", "code", F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])).alias("original"))
            self.store.commit({}, f"sample {load_id}", expected=at, append={"samples": drawn})
        return self.table("samples").where(F.col("load_id") == load_id).count()

    # ------------------------------------------------------------ masters and standards
    def site_table(self, rows: DataFrame, source: str, known: DataFrame | None = None) -> DataFrame:
        """All sites after a load of ``source``: its own under the rules, but for what people set, and those of other sources."""
        prefix = T.code_country(F.col("code"), self.pack.countries)
        proof = sites.prefix_evidence(rows.select("site", prefix.alias("prefix")), "site", "prefix")
        named = sites.site_names(rows, "site", "site_name", ["row_number"])
        text = F.concat_ws(" ", "site", "first_name")
        found = sites.country(text, self.pack.country_rules, F.col("prefixed_share"), F.col("top_prefix"), F.col("dominance"))
        kind = sites.kind(text, self.pack.site_type_rules, self.pack.default_site_type)
        fresh = named.join(proof.drop("n_rows"), "site", "left").select("site", F.col("first_name").alias("site_name"), found.alias("c"), kind.alias("site_type"))
        fresh = fresh.select(F.lit(source).alias("source"), "site", "site_name", "c.country", F.col("c.source").alias("country_source"), "site_type", F.lit(sites.BY_RULE).alias("type_source"))
        return sites.merged(self.table("sites") if known is None else known, fresh, ["source", "site"])

    @tidied
    def standardise(self, load_id: int, actor: str = "rules") -> dict:
        """Masters, brands, families, codes, stock and duplicate groups of a load; applying twice changes nothing."""
        return self.applied(load_id, f"standardise {load_id}", actor)

    def applied(self, load_id: int, action: str, actor: str, append: Mapping[str, DataFrame] | None = None, only: DataFrame | None = None, removed: DataFrame | None = None, restored: DataFrame | None = None, **instead: DataFrame) -> dict | None:
        """Standardise a load with some tables taken from ``instead``; all of them and ``append`` in one commit.

        With ``only`` the products of those masters alone are made anew, those that share
        a duplicate key with them regrouped and ``removed`` ones taken out; the
        commit then writes the buckets they lie in.  The result is that of the whole.
        """
        at = self.store.version()
        before = self.table("standards")
        tables, fresh = self.standard_tables(load_id, instead, only, restored)
        if restored is not None:  # where the load has no row of it, it comes back as it was left
            fresh = fresh.unionByName(restored.drop("duplicate_group", "duplicate_kind").join(fresh, "master_id", "left_anti").select(*fresh.columns))
        stored: dict[str, DataFrame | Written] = {name: df for name, df in {**instead, **tables}.items() if name != "standards"}
        summary, more = None, {"audit": self.event("load", load_id, action, None, None, actor, action)}
        if only is None:
            live = links.open_links(instead.get("links", self.table("links"))).select(F.col("source_id").alias("master_id"))
            old = instead.get("standards", before)
            rest = old.drop("duplicate_group", "duplicate_kind").join(fresh.select("master_id"), "master_id", "left_anti").join(live, "master_id", "left_anti")
            parts = self.catalogue.whole(self.grouped(rest.unionByName(fresh)), tables["masters"].rows.count())
            standards = self.spark.read.schema(STANDARD).parquet(*[w.path for w in parts.values() if w.path]) if any(w.path for w in parts.values()) else self.rows_as("standards", [])
            summary, words = together(partial(self.summarised, load_id, standards, tables["sites"].rows, before), partial(self.reindexed, before, standards, at))
            run = (self.table("runs").agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0] + 1, load_id, json.dumps(summary, sort_keys=True, ensure_ascii=False))
            more = {"runs": self.rows_as("runs", [run]), "audit": self.event("load", load_id, action, None, {"products": summary["products"]}, actor, action)}
            if self.store.has(f"proposals.{load_id}"):
                own = standards.where((F.col("load_id") == load_id) & (F.col("origin") == "import"))
                stored[f"proposals.{load_id}"] = self.store.write("proposals", classify.written_back(self.proposals(load_id), own, self.pack.version))
            stored |= parts
        else:
            changed = self.regrouped(before, fresh, removed)
            stored |= self.catalogue.changed(changed, removed)
            keys = changed.select("master_id") if removed is None else changed.select("master_id").unionByName(removed)
            words = self.reindexed(before.join(keys, "master_id", "left_semi"), changed, at)
        replaced, added = words
        if append:
            more["audit"] = more["audit"].unionByName(append["audit"]) if "audit" in append else more["audit"]
            more |= {name: df for name, df in append.items() if name != "audit"}
        self.store.commit(stored | replaced, action, expected=at, append=more | added)
        return summary

    def regrouped(self, before: DataFrame, fresh: DataFrame, removed: DataFrame | None = None) -> DataFrame:
        """``fresh`` products with their duplicate groups, and the stored ones whose group or kind that changes.

        Only keys that ``fresh`` or ``removed`` products have or had are looked at.
        """
        ids = fresh.select("master_id") if removed is None else fresh.select("master_id").unionByName(removed.select("master_id"))
        had = before.join(ids, "master_id", "left_semi").select("duplicate_key")
        keys = had.unionByName(fresh.select("duplicate_key")).where("duplicate_key IS NOT NULL").distinct()
        peers = before.join(keys, "duplicate_key", "left_semi").join(ids, "master_id", "left_anti").select(*SHOWN)
        every = self.grouped(peers.drop("duplicate_group", "duplicate_kind").unionByName(fresh))
        was = peers.select("master_id", F.col("duplicate_group").alias("_g"), F.col("duplicate_kind").alias("_k"), F.lit(True).alias("_peer"))
        same = F.coalesce("_peer", F.lit(False)) & F.col("_g").eqNullSafe(F.col("duplicate_group")) & F.col("_k").eqNullSafe(F.col("duplicate_kind"))
        return cut(every.join(was, "master_id", "left").where(~same).select(*SHOWN), "changed")

    def reindexed(self, before: DataFrame, after: DataFrame, at: int) -> tuple[dict, dict]:
        """What a commit replaces and adds in the index of words when some products change."""
        if self.words.count() and self.words.folders() < MOST_CHANGES:
            return {}, self.words.added(wordindex.changes(before, after, "master_id", "search_text", at + 1))
        every = after if not self.words.count() else self.table("standards").join(after.select("master_id"), "master_id", "left_anti").join(before.select("master_id"), "master_id", "left_anti").unionByName(after)
        made = wordindex.postings(every, "master_id", "search_text").withColumns({"live": F.lit(True), "seq": F.lit(at + 1).cast("long")})
        return self.words.whole(made, WORDS_A_PRODUCT * every.count()), {}

    def brand_table(self, rows: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Brands by key, where a known name stays, then the alias table's, then the spelling of most codes; and the spellings."""
        key = T.brand_key(F.col("spelling"), self.pack.placeholders, self.pack.brand_aliases)
        spelled = checks.spellings_by_code(rows, "code", "brand", ["row_number"]).withColumn("brand_key", key).where("brand_key IS NOT NULL")
        best = checks.brand_names(spelled, F.col("brand_key")).select("brand_key", F.coalesce(T.canonical_brand(F.col("brand_key"), self.pack.brand_aliases), F.upper("spelling")).alias("brand"))
        return codes.carry_over(kept, best, "brand_key", ["brand"], []), spelled.select("brand_key", "spelling").distinct()

    def mapped(self, source: str, masters: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The codes of a source with the product each stands under, open links and their forest."""
        own, origins = masters.where(F.col("source") == source).select("code", "master_id"), masters.select("master_id", "origin")
        live = links.open_links(log)
        if live.isEmpty():
            nothing = empty(self.spark, "node long, root long, steps long")
            return own.withColumn("linked", F.lit(False)).join(origins, "master_id"), live, nothing
        live = cut(live, "links")
        forest = cut(links.roots(live), "forest")
        return links.under_roots(own, forest, "master_id").join(origins, "master_id"), live, forest

    def standard_tables(self, load_id: int, instead: Mapping[str, DataFrame], only: DataFrame | None = None, restored: DataFrame | None = None) -> tuple[dict[str, Written], DataFrame]:
        """The tables that a load's standardisation replaces, stored already, and its products without their duplicate groups.

        With ``only`` no table but the products of those masters.
        """
        get = lambda name: instead.get(name, self.table(name))
        source = self.load(load_id).source
        rows = self.rows_of(load_id).where("code IS NOT NULL")
        if only is None:
            known = get("masters")
            named, spelled = self.brand_table(rows, get("brands"))
            spellings = spelled.select(F.lit(source).alias("source"), "brand_key", "spelling").unionByName(get("brand_aliases")).distinct()
            write = lambda name, make: (name, self.store.write(name, make()))
            tables = dict(together(
                partial(write, "sites", lambda: self.site_table(rows.where("site IS NOT NULL"), source, instead.get("sites"))),
                partial(write, "masters", lambda: known.unionByName(self.with_masters(rows.where("status = 'accepted'").select("code"), known, source))),
                partial(write, "brands", lambda: named), partial(write, "brand_aliases", lambda: spellings),
            ))
            site_rows, masters, brands = (tables[name].rows for name in ("sites", "masters", "brands"))
        else:
            site_rows, masters, brands, tables = get("sites"), get("masters"), get("brands"), {}
        mapped, live, forest = self.mapped(source, masters, get("links"))
        mine = rows.drop("source").join(mapped if only is None else mapped.join(only.distinct(), "master_id", "left_semi"), "code")
        first = checks.first_row(mine, "master_id", ["linked", "code", "row_number"], ["code", "description", "brand", "model", "product_type", "package", "label_a", "label_b", "origin"])
        base = first.withColumn("brand_key", T.brand_key(F.col("brand"), self.pack.placeholders, self.pack.brand_aliases)).drop("brand").join(brands, "brand_key", "left")
        base = base.withColumn("base", T.normal_name(F.col("description"), self.pack)).withColumn("model", T.standard_model(F.col("model"), self.pack.placeholders))
        base = base.withColumn("status", T.operational_status(F.col("description"), F.col("base"), self.pack.flag_pattern)).withColumn("name", T.standard_name(F.col("base"), F.col("brand"), F.col("model")))
        base = base.withColumn("by_name", classify.families_of_name(F.col("base"), self.pack)).withColumn("by_label", classify.families_of_labels([F.col("label_a"), F.col("label_b")], self.pack.label_aliases))
        automatic = classify.combine(F.col("base"), F.col("by_name"), F.col("by_label"), self.pack.generic_families, F.col("product_type"), F.col("package"), self.pack.bundle_family, self.pack.staff_family)
        base = cut(base.withColumn("automatic", automatic), "base")  # used by codes, stock and groups: computed and planned once
        reviews, old = get("reviews"), get("standards")
        old = old if restored is None else old.unionByName(restored)
        known = old.select("master_id", F.col("standard_code").alias("existing_code"), F.col("family").alias("own_family"))
        item = base.join(reviews.select("master_id", "decision", "reviewed_family"), "master_id", "left").join(known, "master_id", "left")
        item = item.withColumn("d", classify.decide(F.col("decision"), F.col("reviewed_family"), F.col("origin"), F.col("own_family"), F.col("automatic"))).withColumns({"family": F.col("d.family"), "method": F.col("d.method")})

        own_sites = site_rows.where(F.col("source") == source).select("site", "country", "site_type")
        obs = mine.join(own_sites, "site", "left").withColumn("stock", F.coalesce("amount", F.lit(0.0)))
        stock = inventory.stock_map(obs, self.pack.available_types, "master_id").withColumn("stock", F.aggregate(F.map_values("stock_by_country"), F.lit(0.0), lambda a, x: a + x)).drop("stock_text")
        seen = inventory.presence(obs, "master_id").join(inventory.stocked_sites(obs, self.pack.available_types, "master_id"), "master_id")
        legacy = mine.select("master_id", "linked", "code").distinct().groupBy("master_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("linked", "code"))), lambda x: x["code"]).alias("legacy_codes"))
        gone_codes = links.retired(live, forest).withColumnRenamed("root", "master_id")
        prefixes, categories = (F.create_map(*[F.lit(x) for f in self.pack.taxonomy for x in (f, of(f))]) for of in (self.pack.code_prefix, lambda f: self.pack.taxonomy[f][0]))
        item = item.withColumn("prefix", F.when(F.col("status") == T.ACTIVE, F.try_element_at(prefixes, F.col("family")))).withColumn("category", F.try_element_at(categories, F.col("family")))
        item = cut(item, "items")
        used = codes.high_water(old.select(F.col("standard_code").alias("code")).unionByName(get("links").select(F.col("retired_code").alias("code"))).where("code IS NOT NULL"))
        numbered = codes.assign(item.select(F.col("code").alias("item"), "prefix", "existing_code"), used).select(F.col("item").alias("code"), F.col("code").alias("standard_code"))
        wide = item.join(numbered, "code").join(stock, "master_id", "left").join(seen, "master_id", "left").join(legacy, "master_id", "left").join(gone_codes, "master_id", "left")
        key = F.when(F.col("status") == T.ACTIVE, duplicates.key_of(F.col("base"), F.col("brand_key"), F.col("model")))
        words = T.spaced_key(F.concat_ws(" ", "name", "brand", "model", "standard_code", F.array_join("legacy_codes", " "), F.array_join("retired_codes", " "), "description"))
        none = {"countries": F.array().cast("array<string>"), "stock_by_country": F.create_map().cast("map<string,double>"), "stock": F.lit(0.0), "sites_with_stock": F.lit(0).cast("long"), "retired_codes": F.array().cast("array<string>")}
        made = {"load_id": F.lit(load_id).cast("long"), "duplicate_key": key, "search_text": words, **{c: F.coalesce(c, v) for c, v in none.items()}}
        fresh = wide.select(*[made[c].alias(c) if c in made else F.col(c) for c in SHOWN if c not in ("duplicate_group", "duplicate_kind")])
        return tables, cut(fresh, "fresh")

    def grouped(self, rows: DataFrame) -> DataFrame:
        kinds = duplicates.kinds(rows, "duplicate_key").select(F.col("duplicate_key").alias("_k"), F.col("kind").alias("duplicate_kind"))
        return rows.join(kinds, F.col("duplicate_key") == F.col("_k"), "left").withColumn("duplicate_group", F.when(F.col("duplicate_kind").isNotNull(), T.group_id(F.col("duplicate_key")))).select(*SHOWN)

    def summarised(self, load_id: int, standards: DataFrame, site_rows: DataFrame, before: DataFrame) -> dict:
        """The figures of a run: products, codes, methods, duplicates, brands and sites."""
        known = before.where("standard_code IS NOT NULL").select("standard_code")
        same, cross = (F.col("duplicate_kind") == k for k in ("Mismo país", "Otro país"))
        whole = standards.agg(
            F.count("*").alias("products"), F.count("family").alias("classified"), F.count("standard_code").alias("with_code"), F.count_distinct("duplicate_group").alias("groups"),
            F.count_distinct(F.when(same, F.col("duplicate_group"))).alias("groups_same_country"), F.count_distinct(F.when(cross, F.col("duplicate_group"))).alias("groups_other_country"),
            F.count("duplicate_group").alias("duplicate_products"), F.count_distinct("brand").alias("brands"),
        )
        counts = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}
        figures = {
            "one": lambda: whole.first().asDict(), "new_codes": lambda: standards.where("standard_code IS NOT NULL").join(known, "standard_code", "left_anti").count(),
            "methods": lambda: counts(standards, T.short_method(F.col("method"))), "statuses": lambda: counts(standards, "status"), "raw_brands": lambda: self.rows_of(load_id).agg(F.count_distinct("brand")).first()[0],
            "sites_by_country": lambda: counts(site_rows, F.coalesce("country", F.lit(inventory.NO_COUNTRY))), "sites_by_type": lambda: counts(site_rows, "site_type"),
        }
        found = dict(zip(figures, together(*figures.values()), strict=True))
        one = found.pop("one")
        return one | {"load_id": load_id, "percent": round(100 * one["classified"] / one["products"], 1) if one["products"] else 0.0} | found

    def latest_summary(self) -> dict | None:
        row = self.table("runs").orderBy(F.desc("run_id")).first()
        return json.loads(row.summary) if row else None

    def run(self, frame: DataFrame, source: str, key: str, actor: str, reason: str, export_to: str | None = None) -> dict:
        """A file all the way: staged, masters built, sample frozen, standardised and exported; never published."""
        people(actor, reason)
        staged = self.stage(frame, source, key)
        self.build(staged["load_id"])
        self.freeze_sample(staged["load_id"])
        summary = self.standardise(staged["load_id"], actor)
        return {"import": staged, "standardization": summary, "export": self.refresh_export(export_to) if export_to else None}

    def start(self, export_to: str | None = None) -> dict | None:
        """What a server does first: check the store, standardise the newest load if that was never done, and export if asked to."""
        problems = self.problems()
        if problems:
            raise Rejected("the store is damaged: " + "; ".join(problems))
        newest = self.table("loads").agg(F.max("load_id")).first()[0]
        if newest and self.latest_summary() is None:
            self.standardise(newest, "start")
        if newest and export_to:
            self.refresh_export(export_to)
        return self.latest_summary()

    def problems(self) -> list[str]:
        """What is wrong with the store: folders that are gone, products or codes that stand twice, links in a circle."""
        found = [f"{p} is missing" for p in self.store.missing()]
        if found:
            return found
        twice = lambda df, *keys: not df.groupBy(*keys).count().where("count > 1").isEmpty()
        standards, masters = self.table("standards"), self.table("masters")
        tests = {
            "a product stands twice": lambda: twice(standards, "master_id"), "a standard code stands twice": lambda: twice(standards.where("standard_code IS NOT NULL"), "standard_code"),
            "a master number stands twice": lambda: twice(masters, "master_id"), "a source's code has two masters": lambda: twice(masters, "source", "code"),
        }
        found = [name for name, is_so in zip(tests, together(*tests.values()), strict=True) if is_so]
        try:
            links.roots(cut(links.open_links(self.table("links")), "links"))
        except links.Cycle as circle:
            found.append(str(circle))
        return found

    def overlaps(self) -> DataFrame:
        """Stocks that people entered for a product at a site that the current inventory has too."""
        entries = self.table("manual_entries").select("master_id", "site", F.col("stock").alias("entered"))
        return publication.manual_overlaps(entries, self.inventory().select("master_id", "site", F.col("amount").alias("stock")))

    # ------------------------------------------------------------ people
    @tidied
    def review(self, master_id: int, decision: str, family: str | None, revision: str, actor: str, reason: str) -> None:
        """Record a decision and show it in the product at once: family, method and, where it is the first family, a code."""
        people(actor, reason)
        at = self.store.version()
        if decision not in ("approved", "rejected", "pending"):
            raise Rejected("unknown decision")
        if decision == "approved" and family not in self.pack.taxonomy:
            raise Rejected("an approval needs a known family")
        if revision != self.revision(master_id):
            raise Rejected("the product has changed since it was read")
        before = self.product(master_id).asDict()
        after = dict(before, family=family if decision == "approved" else None if decision == "rejected" else before["family"])
        after["category"] = self.pack.taxonomy[after["family"]][0] if after["family"] in self.pack.taxonomy else None
        after["method"] = {"approved": classify.BY_REVIEWER, "rejected": classify.BY_REJECTION, "pending": classify.REOPENED}[decision]
        if after["family"] and after["status"] == T.ACTIVE and not after["standard_code"]:
            after["standard_code"] = self.next_code(after["family"])
            after["search_text"] = " ".join([after["search_text"] or "", *after["standard_code"].split("-")])
        was, row = (self.rows_as("standards", [tuple(v[c] for c in SHOWN)]) for v in (before, after))
        replaced, added = self.reindexed(was, row, at)
        event = self.event("master_product", master_id, decision, before, {"family": after["family"], "method": after["method"]}, actor, reason)
        tables = self.decided.changed(self.rows_as("reviews", [(master_id, decision, family, actor, reason)])) | self.catalogue.changed(row) | replaced
        self.store.commit(tables, f"review {master_id} by {actor}", expected=at, append={"audit": event} | added)

    def product(self, master_id: int):
        """A product's row, from its bucket alone; null if there is none."""
        return self.catalogue.of_keys([master_id]).where(F.col("master_id") == master_id).first()

    def next_code(self, family: str) -> str:
        live = self.table("standards").select(F.col("standard_code").alias("code")).unionByName(self.table("links").select(F.col("retired_code").alias("code")))
        prefix = self.pack.code_prefix(family)
        top = codes.high_water(live.where("code IS NOT NULL")).where(F.col("prefix") == prefix).first()
        return f"{prefix}-{(top.highest if top else 0) + 1:05d}"

    def revision(self, master_id: int) -> str:
        row = self.product(master_id)
        if row is None:
            raise Rejected("no such product")
        decided = self.decided.of_keys([master_id]).where(F.col("master_id") == master_id).first()
        return digest([row.asDict(), decided.asDict() if decided else None])

    def exclude(self, load_id: int, row_number: int, decision: str, actor: str, reason: str) -> None:
        """Leave a quarantined row of a technical code out of the load's publication, or take that back."""
        people(actor, reason)
        at = self.store.version()
        if decision not in ("pending", "exclude"):
            raise Rejected("unknown decision")
        row = self.technical(load_id).where(F.col("row_number") == row_number).first()
        if row is None or not row.eligible:
            raise Rejected("only quarantined rows of the technical codes can be left out; mend other rows at their source")
        if not self.table("publications").where(F.col("load_id") == load_id).isEmpty():
            raise Rejected("the load is published: its scope needs a new load")
        old = self.table("decisions").where(~((F.col("load_id") == load_id) & (F.col("row_number") == row_number)))
        new = self.rows_as("decisions", [(load_id, row_number, decision, actor, reason)])
        self.store.commit({"decisions": old.unionByName(new)}, f"{decision} {load_id}:{row_number} by {actor}", expected=at, append={"audit": self.event("technical_record", f"{load_id}:{row_number}", decision, {"decision": row.decision}, {"decision": decision}, actor, reason)})

    def technical(self, load_id: int) -> DataFrame:
        return publication.technical_rows(self.rows_of(load_id), self.table("decisions"), ["load_id", "row_number"])

    @tidied
    def set_site(self, site: str, country: str | None, kind: str | None, actor: str, reason: str = "confirmed", load_id: int | None = None, source: str | None = None) -> None:
        """Set a site's country, its kind or both by hand; with ``load_id`` the stock of that load follows in the same commit.

        What is not given stays as it is, and as open to rules as it was.  ``source`` is
        needed only where several have a site of that code.
        """
        people(actor, reason)
        at = self.store.version()
        table = self.table("sites")
        found = table.where((F.col("site") == site) & (F.lit(source is None) | (F.col("source") == source))).limit(2).collect()
        if not found:
            raise Rejected("no such site")
        if len(found) > 1:
            raise Rejected("several sources have this site: name one")
        if country is None and kind is None:
            raise Rejected("a country or a kind of site is needed")
        if country is not None and country not in self.pack.countries or kind is not None and kind not in self.pack.site_types:
            raise Rejected("unknown country or kind of site")
        me = (F.col("site") == site) & (F.col("source") == found[0].source)
        changed = sites.set_by_hand(table, me, None if country is None else F.lit(country), None if kind is None else F.lit(kind))
        event = self.event("site", site, "set_site", found[0].asDict(), {"country": country, "site_type": kind}, actor, reason)
        if load_id is None:
            self.store.commit({"sites": changed}, f"site {site} by {actor}", expected=at, append={"audit": event})
        else:
            source = self.load(load_id).source
            at_site = self.rows_of(load_id).where((F.col("site") == site) & F.lit(source == found[0].source)).select("code").distinct()
            mapped, _, _ = self.mapped(source, self.table("masters"), self.table("links"))
            only = cut(mapped.join(at_site, "code", "left_semi").select("master_id").distinct(), "only")
            self.applied(load_id, f"site {site} by {actor}", actor, {"audit": event}, only, sites=cut(changed, "sites"))

    @tidied
    def link(self, source_id: int, target_id: int, load_id: int, actor: str = "people", reason: str = "equivalent") -> int:
        """Put the source, with all that was linked to it, under the target; its standard code is retired, never reused.  One commit."""
        people(actor, reason)
        if source_id == target_id:
            raise Rejected("a product cannot be linked to itself")
        found = {i: self.product(i) for i in (source_id, target_id)}
        found = {i: r for i, r in found.items() if r is not None}
        if len(found) != 2:
            raise Rejected("both products must exist, and stand under no other")
        if found[source_id].origin == "manual":
            raise Rejected("a manual product cannot be the source")
        log, source = self.table("links"), found[source_id]
        link_id = (log.agg(F.max("link_id")).first()[0] or 0) + 1
        new = self.rows_as("links", [(link_id, source_id, source.code, target_id, source.standard_code, source.legacy_codes, False, actor, reason, now())])
        event = self.event("master_product", target_id, "link", None, {"source": source_id, "codes": source.legacy_codes, "retired": source.standard_code}, actor, reason)
        ids = lambda *v: self.spark.createDataFrame([(i,) for i in v], "master_id long")
        self.applied(load_id, f"link {source_id} to {target_id}", actor, {"audit": event}, ids(target_id), ids(source_id), links=cut(log.unionByName(new), "links"))
        return link_id

    @tidied
    def unlink(self, link_id: int, load_id: int, actor: str = "people", reason: str = "not equivalent") -> None:
        """Undo a link, in any order: the source and all below it are a product of their own again, under the code it had.  One commit."""
        people(actor, reason)
        log = self.table("links")
        row = log.where((F.col("link_id") == link_id) & ~F.col("undone")).first()
        if row is None:
            raise Rejected("no such open link")
        changed = cut(log.withColumn("undone", F.col("undone") | (F.col("link_id") == link_id)), "links")
        above = links.roots(cut(links.open_links(log), "links")).where(F.col("node") == row.source_id).first().root
        event = self.event("master_product", row.target_id, "unlink", {"link": link_id}, {"source": row.source_id, "codes": row.codes}, actor, reason)
        back = {"master_id": row.source_id, "load_id": load_id, "code": row.source_code, "standard_code": row.retired_code, "status": T.ACTIVE, "method": UNDONE, "origin": "import", "countries": [], "legacy_codes": list(row.codes or []), "retired_codes": [], "stock_by_country": {}, "stock": 0.0, "sites_with_stock": 0}
        alone = self.rows_as("standards", [tuple(back.get(c) for c in SHOWN)]).withColumn("search_text", T.spaced_key(F.concat_ws(" ", "standard_code", F.array_join("legacy_codes", " "))))
        both = self.spark.createDataFrame([(row.source_id,), (above,)], "master_id long")
        self.applied(load_id, f"unlink {link_id}", actor, {"audit": event}, both, restored=alone, links=changed)

    def propose(self, description: str, brand: str | None = None, model: str | None = None) -> dict:
        """What creating a product would give, with its first exact equals and similar products; nothing is written."""
        one = self.spark.createDataFrame([(description, brand, model)], "description string, brand string, model string")
        base = T.normal_name(F.col("description"), self.pack)
        key = T.brand_key(F.col("brand"), self.pack.placeholders, self.pack.brand_aliases)
        model_ = T.standard_model(F.col("model"), self.pack.placeholders)
        row = one.select(base.alias("base"), key.alias("brand_key"), F.upper(T.clean(F.col("brand"))).alias("upper"), model_.alias("model")).first()
        if row.base is None:
            raise Rejected("no usable name")
        known = self.table("brands").where(F.col("brand_key") == row.brand_key).first() if row.brand_key else None
        brand_name = known.brand if known else row.upper if row.brand_key else None
        made = self.spark.createDataFrame([(row.base, brand_name, row.model, row.brand_key)], "base string, brand string, model string, brand_key string")
        made = made.withColumn("by_name", classify.families_of_name(F.col("base"), self.pack))
        decision = classify.combine(F.col("base"), F.col("by_name"), F.array().cast("array<string>"), self.pack.generic_families, F.lit("ITEM"), F.lit("ITEM"), self.pack.bundle_family, self.pack.staff_family)
        dup = duplicates.key_of(F.col("base"), F.col("brand_key"), F.col("model"))
        out = made.select(T.standard_name(F.col("base"), F.col("brand"), F.col("model")).alias("name"), "brand", "model", decision.alias("d"), dup.alias("duplicate_key"), T.spaced_key(F.col("base")).alias("words")).select("*", "d.family", "d.method").drop("d").first().asDict()
        standards = self.table("standards")
        exact = standards.where(F.col("duplicate_key") == out["duplicate_key"])
        alike, _ = search.search(self.products_with(wordindex.tokens_of(" ".join(out["words"].split()[:3]))), limit=8)
        out["exact"] = [r.master_id for r in exact.select("master_id").orderBy("master_id").limit(MOST_ROWS).collect()]
        out["similar"] = [r.master_id for r in alike.join(exact.select("master_id"), "master_id", "left_anti").select("master_id").collect()]
        return out

    @tidied
    def create(self, request_id: str, description: str, brand: str | None = None, model: str | None = None, confirm_duplicate: bool = False, product_type: str = "ITEM", site: str | None = None, stock: str | None = None, actor: str = "people", reason: str = "new product", package: str = "ITEM") -> int:
        """Add a manual product, with an observed stock at a site if given; the same request again gives the same product, another payload is refused."""
        people(actor, reason)
        if not request_id.strip():
            raise Rejected("a request id is needed")
        at = self.store.version()
        if product_type not in ENUMS["product_type"] or package not in ENUMS["package"]:
            raise Rejected("unknown type of product or package")
        payload = digest([description, brand, model, product_type, package, site, stock])
        seen = self.table("requests").where(F.col("request_id") == request_id).first()
        if seen:
            if seen.payload != payload:
                raise Rejected("this request id was used for another product")
            return seen.master_id
        amount = self.spark.createDataFrame([(stock or "",)], "s string").select(T.decimal_text(F.col("s")).alias("d")).select("d.*").first()
        if amount.error:
            raise Rejected(amount.error)
        if amount.value is not None and site is None:
            raise Rejected("a stock needs a site")
        if site is not None and self.table("sites").where(F.col("site") == site).isEmpty():
            raise Rejected("no such site")
        plan = self.propose(description, brand, model)
        if plan["exact"] and not confirm_duplicate:
            raise Rejected("an equal product exists")
        masters, standards = self.table("masters"), self.table("standards")
        master_id = (masters.agg(F.max("master_id")).first()[0] or 0) + 1
        code = self.next_code(plan["family"]) if plan["family"] else None
        name = f"manual-{master_id}"
        own = {c: plan.get(c) for c in ("name", "brand", "model", "family", "duplicate_key")}
        own |= {"master_id": master_id, "code": name, "standard_code": code, "category": self.pack.taxonomy[plan["family"]][0] if plan["family"] else None, "product_type": product_type, "package": package}
        own |= {"method": classify.BY_HAND if plan["family"] else classify.NO_RULE, "status": T.ACTIVE, "countries": [], "stock_by_country": {}, "stock": 0.0, "sites_with_stock": 0, "legacy_codes": [], "retired_codes": [], "origin": "manual"}
        new = self.rows_as("standards", [tuple(own.get(c) for c in SHOWN)]).withColumn("search_text", T.spaced_key(F.concat_ws(" ", "name", "brand", "model", "standard_code")))
        append = {"masters": self.rows_as("masters", [("manual", name, master_id, "manual")]), "requests": self.rows_as("requests", [(request_id, payload, master_id)]), "audit": self.event("master_product", master_id, "manual_create", None, {"name": plan["name"], "product_type": product_type, "package": package}, actor, reason)}
        if site is not None:
            append["manual_entries"] = self.rows_as("manual_entries", [(master_id, site, float(amount.value) if amount.value is not None else None, actor, reason)])
        changed = self.regrouped(standards, new.drop("duplicate_group", "duplicate_kind"))
        replaced, added = self.reindexed(standards.limit(0), new, at)
        self.store.commit(self.catalogue.changed(changed) | replaced, f"create {master_id}", expected=at, append=append | added)
        return master_id

    # ------------------------------------------------------------ publication
    def current(self, source: str):
        """The publication that is current for a source."""
        return self.table("publications").where(F.col("source") == source).orderBy(F.desc("load_id")).first()

    def preview(self, load_id: int) -> dict:
        """Counts and the token that a publication must repeat."""
        load, rows = self.load(load_id), self.rows_of(load_id)
        state = publication.load_states(self.table("loads").where(F.col("load_id") == load_id), self.table("publications")).first()
        current = self.current(load.source)
        before = self.table_of_snapshots().where((F.col("source") == load.source) & (F.col("load_id") == (current.load_id if current else -1)))
        waiting = self.reviewed(load_id).where(F.col("status").isin(classify.PENDING, classify.REFUSED))
        errors = sum(i.severity == "error" for i in load.issues)
        counts = publication.preview(rows.withColumn("accepted", F.col("status") == "accepted"), before, self.technical(load_id), self.own_masters(load.source), errors, waiting).first().asDict()
        counts |= {"load_id": load_id, "stale": state.stale, "already_published": state.already_published, "last": current.snapshot_at if current else None, "last_basis": current.date_basis if current else None}
        blocked = counts["stale"] or counts["already_published"] or counts["unresolved"] or counts["global_errors"] or counts["missing_masters"]
        counts["ready"] = not blocked and counts["accepted"] > 0
        return counts | {"token": digest(counts)}

    def own_masters(self, source: str) -> DataFrame:
        """Masters of a source's codes; the same code of another source is another product."""
        return self.table("masters").where(F.col("source") == source).drop("source")

    def reviewed(self, load_id: int) -> DataFrame:
        """The load's conservative reviews with their masters, under what people decided."""
        own = self.own_masters(self.load(load_id).source).select("code", "master_id")
        return classify.with_decisions(self.proposals(load_id).join(own, "code", "left"), self.table("reviews"))

    def table_of_snapshots(self) -> DataFrame:
        return self.store.read("snapshots") if self.store.has("snapshots") else empty(self.spark, "source string, load_id long, code string, site string, amount double, master_id long")

    @tidied
    def publish(self, load_id: int, token: str, snapshot_at: str | None, full_snapshot: bool = False, date_basis: str = "confirmed", actor: str = "people", reason: str = "publication") -> dict:
        """Make a load the current inventory of its source: facts, commercial values, flags and labels in one commit."""
        people(actor, reason)
        at = self.store.version()
        if full_snapshot is not True:
            raise Rejected("confirm that the file is complete for its source")
        if date_basis not in ("confirmed", "received_at"):
            raise Rejected("unknown basis of the date")
        plan = self.preview(load_id)
        if plan["token"] != token:
            raise Rejected("the preview is out of date")
        if not plan["ready"]:
            raise Rejected("the load is not ready")
        load = self.load(load_id)
        date = load.received_at if date_basis == "received_at" else snapshot_at
        last = plan["last"] if date_basis == plan["last_basis"] == "confirmed" else None
        fits = self.spark.createDataFrame([(date, last)], "now string, last string").select(publication.publishable(F.col("now"), F.col("last"))).first()[0]
        if not fits:
            raise Rejected("the cut-off needs a time zone and must be later than the last one")
        rows = self.rows_of(load_id)
        accepted = rows.where("status = 'accepted'")
        wrong = publication.unknown_flags(accepted, PUBLISHED_FLAGS).orderBy("field", "value").first()
        if wrong:
            raise Rejected(f"unknown flag: {wrong.field}={wrong.value}")
        keep = ["source", "load_id", "row_number", "site", "amount", "bin_location", "shelf_location"]
        facts = self.store.write("snapshots", publication.snapshots(rows, self.own_masters(load.source), NUMBERS[1:], {**FLAGS, **PUBLISHED_FLAGS}, keep))
        own = self.table("row_labels").where(F.col("load_id") == load_id).join(facts.rows.select("row_number"), "row_number", "left_semi")
        names = sites.site_names(accepted.where("site IS NOT NULL"), "site", "site_name", ["row_number"]).select(F.lit(load.source).alias("_o"), F.col("site").alias("_s"), "first_name")
        tables = {}
        if self.store.has("sites"):
            old = self.store.read("sites")
            tables["sites"] = old.join(names, (F.col("site") == F.col("_s")) & (F.col("source") == F.col("_o")), "left").withColumn("site_name", F.coalesce("first_name", "site_name")).select(*old.columns)
        made = self.rows_as("publications", [(load.source, load_id, date, date_basis, actor, reason, now())])
        n = facts.rows.count()
        event = self.event("load", load_id, "publish_full_snapshot", plan, {"rows": n, "excluded": plan["excluded"], "date_basis": date_basis, "at": date}, actor, reason)
        self.store.commit(tables, f"publish {load_id}", expected=at, append={"publications": made, "snapshots": facts, "snapshot_labels": own, "audit": event})
        return {"published": True, "rows": n, "load_id": load_id, "date_basis": date_basis, "at": date}

    def inventory(self, at: str | None = None) -> DataFrame:
        """The current facts: of each source those of its newest publication, or of the newest whose cut-off is not after ``at``."""
        published = self.table("publications")
        if at is not None:
            published = published.where(F.try_to_timestamp("snapshot_at") <= F.try_to_timestamp(F.lit(at)))
        active = checks.newest(published, "source", ["load_id"], ["load_id"])
        return self.table_of_snapshots().join(active, ["source", "load_id"], "left_semi")

    # ------------------------------------------------------------ reading
    @tidied
    def search(self, query: str = "", country: str | None = None, named: str | None = None, limit: int = 50, offset: int = 0, family: str | None = None, category: str | None = None) -> tuple[list, int]:
        key = self.spark.createDataFrame([(query,)], "q string").select(T.spaced_key(F.col("q"))).first()[0]
        rows = self.products_with(wordindex.tokens_of(key))
        page, total = search.search(rows, "", country, named, limit, offset, family, category)
        return page.collect(), total.first()[0]

    def products_with(self, tokens: Sequence[str]) -> DataFrame:
        """Products with a word for every token, by the index: the tokens' buckets are read, and of the catalogue, where few are found, theirs."""
        if not tokens or not self.words.count():
            return self.table("standards") if not tokens else self.table("standards").limit(0)
        ids, most = wordindex.intersected([wordindex.found(self.words.of_keys([t[: wordindex.LONGEST]]), t) for t in tokens])
        if most <= FEW_FOUND:
            few = [r.id for r in ids.collect()]
            return self.catalogue.of_keys(few).where(F.col("master_id").isin(few)) if few else self.table("standards").limit(0)
        ids = ids.withColumnRenamed("id", "master_id")
        return self.table("standards").join(F.broadcast(ids) if most <= wordindex.FEW else ids, "master_id", "left_semi")

    def detail(self, master_id: int, most: int = MOST_ROWS) -> dict:
        """A product: its observations (available stock first, at most ``most``), stock by country, equals, links and history."""
        product = self.product(master_id)
        if product is None:
            raise Rejected("no such product")
        out = {"product": product, "rows": [], "stock": [], "originals": {}}
        codes_ = list(product.legacy_codes or [])
        if product.load_id and codes_:
            own = self.rows_of(product.load_id).where(F.col("code").isin(codes_)).withColumn("stock", F.coalesce("amount", F.lit(0.0)))
            mine = self.spark.createDataFrame([(master_id, product.load_id, codes_)], "master_id long, load_id long, legacy_codes array<string>")
            known = self.table("sites").where(F.col("source") == self.load(product.load_id).source)
            rows = inventory.own_rows(mine, own.where("site IS NOT NULL"), known, self.pack.available_types)
            out["rows"] = inventory.in_detail_order(rows.select("code", "site", "country", "site_type", "stock", "available")).limit(most).collect()
            out["stock"] = inventory.stock_of_products(rows).orderBy(F.col("country") == inventory.NO_COUNTRY, "country").collect()
            first = checks.first_row(own, "code", ["row_number"], ["description", "brand", "model", "product_type", "package", "label_a", "label_b", "label_e"])
            out["originals"] = {r.code: r.asDict() for r in first.limit(most).collect()}
        out["manual_stock"] = self.table("manual_entries").where(F.col("master_id") == master_id).select("site", "stock").collect()
        equal = (F.col("duplicate_group") == product.duplicate_group) & (F.col("master_id") != master_id)
        out["duplicates"] = self.table("standards").where(equal).orderBy("standard_code", "master_id").limit(most).collect() if product.duplicate_group else []
        out["links"] = self.table("links").where((F.col("target_id") == master_id) & ~F.col("undone")).orderBy("link_id").limit(most).collect()
        out["history"] = self.table("audit").where((F.col("entity") == "master_product") & (F.col("entity_id") == str(master_id))).orderBy(F.desc("at")).limit(10).collect()
        return out

    def sites(self, most: int = MOST_SITES) -> list:
        """Sites without a country first, then by name; ``most`` of them at most."""
        return self.table("sites").orderBy(F.col("country").isNotNull(), "site_name", "source", "site").limit(most).collect()

    def review_rows(self, load_id: int) -> DataFrame:
        """The load's conservative reviews with their products and why they wait, in order of the code."""
        shown = self.table("standards").select("master_id", "standard_code", "name")
        group = classify.pending_group(F.col("status"), F.col("reason"), F.size("lexical"), F.size("labels"), F.col("family"))
        return self.reviewed(load_id).join(shown, "master_id", "left").withColumn("waits_as", group).orderBy("code")

    def state(self, load_id: int | None = None, most: int = MOST_ROWS) -> dict:
        """What a screen shows: loads, latest run, sites, countries with stock, manual products and the chosen load's reviews, issues and preview."""
        loads = self.table("loads").orderBy(F.desc("load_id")).limit(most).collect()
        load_id = load_id or (loads[0].load_id if loads else None)
        standards = self.table("standards")
        by_country = standards.select(F.explode("stock_by_country").alias("country", "quantity")).groupBy("country").agg(F.count("*").alias("products"))
        out = {
            "loads": loads, "load_id": load_id, "latest": self.latest_summary(), "sites": self.sites(), "site_types": list(self.pack.site_types), "families": sorted(self.pack.taxonomy),
            "stock_countries": by_country.orderBy(F.col("country") == inventory.NO_COUNTRY, "country").collect(),
            "manual_products": standards.where("origin = 'manual'").orderBy(F.desc("master_id")).limit(20).select("code", "standard_code", "name").collect(),
        }
        if load_id is None:
            return out | {"rows": [], "counts": {}, "groups": {}, "technical": [], "issues": [], "preview": None, "sample": []}
        rows = self.review_rows(load_id)
        return out | {
            "rows": rows.limit(most).collect(), "counts": {r.status: r["count"] for r in rows.groupBy("status").count().collect()},
            "groups": {r.waits_as: r["count"] for r in rows.where("status = 'pending'").groupBy("waits_as").count().collect()},
            "technical": self.technical(load_id).orderBy("row_number").limit(most).collect(), "issues": self.report(load_id).collect(), "preview": self.preview(load_id),
            "sample": [r.code for r in self.table("samples").where(F.col("load_id") == load_id).collect()],
        }

    # ------------------------------------------------------------ export
    @tidied
    def export(self, path: str, attempts: int = 5, wait: Callable[[int], float] = lambda n: 0.2 * n) -> dict:
        """The mart as Parquet tables below ``path``; returns rows by table.

        Tables are written beside ``path`` and checked; then the folder is replaced.
        Readers find the old mart or the new one.  A folder that cannot be replaced
        after some attempts raises :class:`ExportLocked` and stays as it was.
        """
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        draft, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{kind}-{time.time_ns()}") for kind in ("draft", "old"))
        try:
            counts = self.exported(draft.toString())
            for attempt in range(1, attempts + 1):
                try:
                    moved = not fs.exists(target) or fs.rename(target, old)
                    if moved and fs.rename(draft, target):
                        fs.delete(old, True)
                        return counts
                except Exception as failed:  # a reader may hold files open: try again
                    if attempt == attempts:
                        raise ExportLocked(path) from failed
                finally:
                    if fs.exists(old) and not fs.exists(target):
                        fs.rename(old, target)
                time.sleep(wait(attempt))
            raise ExportLocked(path)
        finally:
            fs.delete(draft, True)

    def refresh_export(self, path: str) -> dict:
        """Export after a change; a locked mart is reported, not raised: the change itself is done."""
        try:
            return {"path": path, "tables": self.export(path)}
        except ExportLocked as locked:
            return {"path": path, "locked": str(locked)}

    def exported(self, path: str) -> dict:
        s, site_rows, masters = self.table("standards"), self.table("sites"), self.table("masters")
        newest = s.agg(F.max("load_id")).first()[0]  # the last load that was standardised, not the last that came in
        load = self.load(newest) if newest else None
        info = {"exported_at": now(), "rules": self.pack.version, "load_id": newest, "source": load.source if load else None, "key": load.key if load else None, "inventory": "observed in the last standardised load; a publication says what is current"}
        families = [(f, c, self.pack.code_prefix(f)) for f, (c, _, _) in sorted(self.pack.taxonomy.items())]
        live = cut(links.open_links(self.table("links")), "links")
        mapped = links.under_roots(masters.where("origin = 'import'"), links.roots(live), "master_id").join(s.select("master_id"), "master_id", "left_semi")
        mapped = cut(mapped.select("source", "code", "master_id"), "mapped")
        rows = self.rows_of(newest) if newest else self.store.read_or_empty("rows", "load_id long, row_number long, code string, site string, status string, amount double, cost string, replacement_cost string, description string")
        own = mapped.where(F.col("source") == (load.source if load else "")).drop("source")
        described = checks.first_row(rows.where("code IS NOT NULL"), "code", ["row_number"], ["description"])
        number = lambda c: F.col(c).try_cast("double").alias(c)
        facts = rows.select("load_id", "status", "code", "site", F.col("amount").alias("stock"), number("cost"), number("replacement_cost"))
        text = F.array_join(F.transform(F.array_sort(F.map_entries("stock_by_country")), lambda e: F.concat(e["key"], F.lit(": "), T.general_number(e["value"]))), " · ")
        tables: Mapping[str, DataFrame] = {
            "products": s.withColumns({"presence": F.nullif(F.array_join("countries", ", "), F.lit("")), "stock_text": F.nullif(text, F.lit(""))}).drop("countries", "stock_by_country", "stock", "legacy_codes", "retired_codes", "search_text"),
            "stock_by_country": s.select("master_id", F.explode("stock_by_country").alias("country", "quantity")),
            "source_codes": mapped.join(described.withColumn("source", F.lit(load.source if load else "")), ["source", "code"], "left").select("source", F.col("code").alias("source_code"), "master_id", "description"),
            "sites": site_rows.withColumn("available", F.coalesce(F.col("site_type").isin(*self.pack.available_types), F.lit(False))),
            "countries": self.spark.createDataFrame([(c,) for c in self.pack.countries], "country string"),
            "brands": self.table("brands"),
            "brand_aliases": self.table("brand_aliases"),
            "categories": self.spark.createDataFrame(sorted({(c, p) for c, p, _ in self.pack.taxonomy.values()}), "category string, prefix string"),
            "families": self.spark.createDataFrame(families, "family string, category string, prefix string"),
            "retired_codes": live.where("retired_code IS NOT NULL").select("retired_code", "target_id", F.array_join("codes", ", ").alias("codes"), "actor", "reason", "at"),
            "inventory": publication.load_inventory(facts, own, site_rows.where(F.col("source") == (load.source if load else "")), ["stock", "cost", "replacement_cost", "load_id"]),
            "metadata": self.spark.createDataFrame([(k, None if v is None else str(v)) for k, v in info.items()], "name string, value string"),
        }
        together(*[partial(df.write.parquet, f"{path}/{name}") for name, df in tables.items()])
        back = {name: self.spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()}
        wrong = {"products are not unique": lambda: back["products"].groupBy("master_id").count().where("count > 1").isEmpty()}
        for name in ("stock_by_country", "source_codes"):
            wrong[f"{name} names unknown products"] = back[name].join(back["products"], "master_id", "left_anti").isEmpty
        for problem, fine in zip(wrong, together(*wrong.values()), strict=True):
            if not fine:
                raise ValueError(problem)
        return dict(zip(back, together(*[df.count for df in back.values()]), strict=True))


#: Fixed value: the method of a product whose link was undone.
UNDONE = "Revisar: vínculo deshecho"


def describe_mart(spark: SparkSession, path: str, tables: Sequence[str]) -> dict:
    """What an exported mart holds: its metadata, and columns and rows of its tables."""
    read = {t: spark.read.parquet(f"{path}/{t}") for t in tables}
    meta = {r.name: r.value for r in read["metadata"].collect()} if "metadata" in read else {}
    return {"metadata": meta, "tables": {t: {"columns": df.columns, "rows": df.count()} for t, df in read.items()}}
