"""Client folders from one file inventory: roles, reference document, sources, readiness, manifest.

The inventory has client_id, path, folder (first directory below the client, '' for its root), name, suffix,
size_bytes, mtime. It is listed once; everything is an aggregation or window by client.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier_spark.functions import text as X

from .ordering import numbered
from .sections import ratio

# Folder roles and the names they go by.
ROLES = {
    "01_personnel": ("01 Dossier personnel", "01", "Dossier personnel"),
    "02_cv": ("02 CV", "02", "CV"),
    "03_tests": ("03 Tests et bilans", "03", "Tests"),
    "04_stages": ("04 Stages", "04", "Stages"),
    "05_mesures": ("05 Mesures AI", "05", "Mesures"),
    "06_rapport": ("06 Rapport final", "06", "Rapport final", "Rapports"),
    "07_suivi": ("07 Suivi", "07", "Suivi"),
}
# Words in the name of a reference document.
KEYWORDS = ("rapport", "bilan", "orientation", "synthese", "synthèse", "final", "conclusion", "evaluation", "évaluation")
# Words of templates, which are no reference documents.
TEMPLATE_WORDS = ("template", "modele", "modèle", "vierge", "copie")
DOCUMENTS, GOLD = (".docx", ".pdf", ".txt", ".msg", ".doc"), (".docx", ".doc")
SOURCE_ROLES = ("01_personnel", "03_tests", "04_stages", "05_mesures")
AUDIO = ("m4a", "mp3", "wav")
STRATEGIES = ("06_rapport_final", "recursive_scan", "most_recent_fallback")


def role_of(folder: Column) -> Column:
    """The role a folder name stands for, null if none."""
    out = F.lit(None).cast("string")
    for role, variants in ROLES.items():
        out = F.coalesce(out, F.when(X.fold_spaces(folder).isin([v.lower() for v in variants]), F.lit(role)))
    return out


def gold_score(name: Column, folder: Column, suffix: Column) -> Column:
    """How likely a file is the reference document, 0 to 1."""
    low = F.lower(name)
    hits = F.aggregate(F.array(*map(F.lit, KEYWORDS)), F.lit(0), lambda n, k: n + F.contains(low, k).cast("int"))
    where = X.fold_spaces(folder)
    template = F.exists(F.array(*map(F.lit, TEMPLATE_WORDS)), lambda k: F.contains(low, k))
    i = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    s = i(where.contains("rapport") | where.contains("06"), 0.3) + F.least(hits * 0.15, F.lit(0.45)) + i(suffix == ".docx", 0.15) - i(template, 0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def roles(files: DataFrame, spark: SparkSession) -> DataFrame:
    """(client_id, role, folder): folder null where the client lacks the role."""
    dim = spark.createDataFrame([(r,) for r in ROLES], "role string")
    have = files.select("client_id", role_of(F.col("folder")).alias("role"), "folder").filter("role is not null").groupBy("client_id", "role").agg(F.min("folder").alias("folder"))
    # the roles are seven constants: each client gets them by explode, not by a join of all with all
    wanted = files.select("client_id").distinct().select("client_id", F.explode(F.array(*map(F.lit, ROLES))).alias("role"))
    return wanted.join(have, ["client_id", "role"], "left").join(dim, "role", "left_semi").select("client_id", "role", "folder")


def gold_candidates(files: DataFrame) -> DataFrame:
    """Candidates of each client with tier and score, the chosen one flagged (W4). The choice is a grouped least, combined
    before the shuffle, so a client's files are never sorted in one task."""
    f = files.filter(F.lower("suffix").isin(*GOLD)).withColumn("score", gold_score(F.col("name"), F.col("folder"), F.col("suffix")))
    f = f.withColumn("tier", F.when(role_of(F.col("folder")) == "06_rapport", 1).when(F.col("score") > 0.1, 2).otherwise(3))
    f = f.withColumn("_order", _gold_order())
    best = f.groupBy("client_id").agg(F.min("_order").alias("_best"))
    f = f.join(best, "client_id").withColumn("selected", F.col("_order") == F.col("_best")).drop("_order", "_best")
    return f.withColumn("score", F.when(F.col("tier") == 3, F.lit(0.5)).otherwise(F.col("score"))).withColumn("strategy", F.element_at(F.array(*map(F.lit, STRATEGIES)), F.col("tier")))


def _gold_order() -> Column:
    """How candidates are preferred: tier, then score, or age in the last tier, then path."""
    last = F.col("tier") == 3
    return F.struct("tier", F.when(last, F.lit(0.0)).otherwise(-F.col("score")).alias("s"), F.when(last, -F.col("mtime").cast("double")).otherwise(F.lit(0.0)).alias("m"), "path")


def gold(files: DataFrame) -> DataFrame:
    return gold_candidates(files).filter("selected").select("client_id", "path", "score", "strategy", "size_bytes")


def sources(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """Documents of the source folders and of the client's root, with their category, without the reference document."""
    docs = files.filter(F.lower("suffix").isin(*DOCUMENTS)).withColumn("category", _category(F.col("folder"))).filter(F.col("category").isNotNull())
    return docs.join(chosen.select("client_id", "path"), ["client_id", "path"], "left_anti")


def _category(folder: Column) -> Column:
    role = role_of(folder)
    return F.when(role.isin(*SOURCE_ROLES), role).when(folder == "", F.lit("root"))


def scan(files: DataFrame, spark: SparkSession) -> DataFrame:
    """One row for each client: reference document, counts, roles, warnings, readiness and expected quality.

    One scan of the inventory and one aggregation by client: the reference document is a grouped least, and what it counts
    as a source itself is taken off afterwards.
    """
    low = F.lower("suffix")
    f = files.withColumn("role", role_of(F.col("folder"))).withColumn("score", F.when(low.isin(*GOLD), gold_score(F.col("name"), F.col("folder"), F.col("suffix"))))
    f = f.withColumn("tier", F.when(F.col("score").isNotNull(), F.when(F.col("role") == "06_rapport", 1).when(F.col("score") > 0.1, 2).otherwise(3)))
    f = f.withColumn("is_source", low.isin(*DOCUMENTS) & _category(F.col("folder")).isNotNull())
    candidate = F.when(F.col("tier").isNotNull(), F.struct(_gold_order().alias("o"), "score", F.col("size_bytes").alias("bytes"), "is_source"))
    have = [F.max(F.col("role") == r).alias(f"_{r}") for r in ROLES]
    c = f.groupBy("client_id").agg(F.min(candidate).alias("g"), F.count_if("is_source").alias("listed"), F.sum(F.when(F.col("is_source"), F.col("size_bytes"))).alias("bytes"), *have)
    own = F.coalesce(F.col("g.is_source"), F.lit(False))
    c = c.withColumn("n_sources", F.col("listed") - F.when(own, 1).otherwise(0))
    found = sum((F.coalesce(F.col(f"_{r}"), F.lit(False)).cast("int") for r in ROLES), F.lit(0))
    critical = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"_{r}"), F.lit(False)), F.lit(r)) for r in ("01_personnel", "06_rapport")]))
    tier, n = F.col("g.o.tier"), F.col("n_sources")
    c = c.withColumn("gold", F.col("g.o.path")).withColumn("score", F.when(tier == 3, F.lit(0.5)).otherwise(F.col("g.score"))).withColumn("critical", critical)
    notes = F.array_compact(
        F.array(
            F.when(F.col("gold").isNull(), F.lit("no reference document")).when(F.col("score") < 0.5, F.format_string("weak reference document (%.2f)", F.bround("score", 2))),
            F.when(n == 0, F.lit("no sources")).when(n < 3, F.format_string("few sources (%d)", n)),
            F.when(F.size("critical") > 0, F.concat(F.lit("missing folders: "), F.array_join("critical", ", "))),
        )
    )
    ready = F.col("gold").isNotNull() & (n > 0) & (F.col("score") >= 0.3)
    quality = F.when((n >= 5) & (F.col("score") >= 0.6), "high").when((n >= 2) & (F.col("score") >= 0.4), "medium").otherwise("low")
    # the reference document's bytes are counted once, whether or not it lies among the sources
    mb = (F.coalesce("bytes", F.lit(0)) + F.when(own, F.lit(0)).otherwise(F.coalesce(F.col("g.bytes"), F.lit(0)))) / 1048576
    strategy = F.element_at(F.array(*map(F.lit, STRATEGIES)), tier)
    return c.select("client_id", "gold", F.coalesce("score", F.lit(0.0)).alias("gold_score"), strategy.alias("strategy"), "n_sources", F.bround(mb, 2).alias("total_mb"), found.cast("long").alias("roles_found"), (F.lit(len(ROLES)) - found).cast("long").alias("roles_missing"), notes.alias("warnings"), F.coalesce(ready, F.lit(False)).alias("ready"), quality.alias("quality"))


def extension_counts(files: DataFrame) -> DataFrame:
    """(client_id, suffix, n, place): most frequent first, then by name."""
    n = files.groupBy("client_id", "suffix").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("n"), "suffix")))


def sandbox_names(src: DataFrame) -> DataFrame:
    """Sandbox names: category, three-digit number within the client, slug."""
    n = numbered(src, "client_id", ["category", "path"], "n")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return src.join(n.select("client_id", "path", "n"), ["client_id", "path"]).withColumn("target", F.concat(F.col("category"), F.lit("_"), F.format_string("%03d", "n"), F.lit("_"), X.slug_words(stem), F.col("suffix")))


def file_counts(files: DataFrame) -> DataFrame:
    """(client_id, gold, sources, total) of the clients that have a reference document and sources."""
    g = gold(files)
    n = sources(files, g).groupBy("client_id").agg(F.count("*").alias("sources"))
    return g.join(n, "client_id").select("client_id", F.lit(1).alias("gold"), "sources", (F.col("sources") + 1).alias("total"))


def manifest(files: DataFrame, batch: str, per_part: int = 1000) -> DataFrame:
    """(client_id, part, n_sources, meta): the JSON manifest of each client that has a reference document and sources. A part lists at
    most per_part of its sources, in order; the counts are the client's (S17)."""
    g = gold(files)
    named = sandbox_names(sources(files, g)).withColumn("part", F.floor((F.col("n") - 1) / per_part).cast("int"))
    listed = named.groupBy("client_id", "part").agg(F.array_sort(F.collect_list("target")).alias("sources"))
    n = named.groupBy("client_id").agg(F.count("*").alias("n_sources"))
    counts = F.struct(F.lit(1).alias("gold"), F.col("n_sources").alias("sources"), (F.col("n_sources") + 1).alias("total"))
    row = F.struct(F.lit(batch).alias("batch"), X.slug_client(F.col("client_id")).alias("slug"), F.col("path").alias("gold"), "sources", counts.alias("file_counts"))
    return g.join(n, "client_id").join(listed, "client_id").select("client_id", "part", "n_sources", F.to_json(row).alias("meta"))


def readiness_summary(scanned: DataFrame) -> DataFrame:
    """Totals and rate in percent over scanned clients."""
    n, r = F.count("*"), F.count_if("ready")
    return scanned.agg(n.alias("total"), r.alias("ready"), (n - r).alias("not_ready"), F.bround(F.coalesce(100.0 * r / F.nullif(n, F.lit(0)), F.lit(0.0)), 1).alias("rate"))


def requested(names: DataFrame, scanned: DataFrame) -> DataFrame:
    """Requested clients: success, not_ready, or error where there is no such folder."""
    s = scanned.select("client_id", "ready")
    return names.join(s, "client_id", "left").withColumn("outcome", F.when(F.col("ready").isNull(), "error").when(F.col("ready"), "success").otherwise("not_ready"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Successes, not ready, errors and rate."""
    n = F.count("*")
    c = lambda v: F.count_if(F.col("outcome") == v)
    return outcomes.agg(n.alias("total"), c("success").alias("success"), c("not_ready").alias("not_ready"), c("error").alias("errors"), F.bround(F.coalesce(100.0 * c("success") / F.nullif(n, F.lit(0)), F.lit(0.0)), 1).alias("rate"))


def stale(files: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """Clients with a file newer than their last extraction, or none yet, or all if forced."""
    newest = files.groupBy("client_id").agg(F.max("mtime").alias("newest"))
    return newest.join(runs, "client_id", "left").filter(F.lit(force) | F.col("extracted_at").isNull() | (F.col("newest") > F.col("extracted_at"))).select("client_id")


def by_type(files: DataFrame) -> DataFrame:
    """Which kinds of file a client has directly in its folder (F11). files: client_id, folder, name, suffix."""
    own = files.filter("folder = ''")
    some = lambda *kinds: F.coalesce(F.max(F.lower("suffix").isin(*kinds)), F.lit(False))
    kinds = own.groupBy("client_id").agg(some(".docx").alias("has_docx"), some(".pdf").alias("has_pdf"), some(".txt").alias("has_txt"), some(*("." + a for a in AUDIO)).alias("has_audio"))
    no = F.lit(False)
    d = files.select("client_id").distinct().join(kinds, "client_id", "left").select("client_id", *[F.coalesce(k, no).alias(k) for k in ("has_docx", "has_pdf", "has_txt", "has_audio")])
    return d.withColumn("has_files", F.col("has_docx") | F.col("has_pdf") | F.col("has_txt") | F.col("has_audio"))


def visible_folders(files: DataFrame, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """(client_id, folder): the direct folders of each client that are neither hidden nor left out."""
    hidden = F.col("folder").startswith(".") | F.col("folder").isin("", *leave_out)
    return files.filter(~hidden).select("client_id", "folder").distinct()


def directory_order(files: DataFrame) -> DataFrame:
    """(client_id, name, is_dir, place): entries of each client's folder, folders first, then by lower-cased name; hidden
    ones are left out (T3)."""
    dirs = visible_folders(files).select("client_id", F.col("folder").alias("name"), F.lit(True).alias("is_dir"))
    own = files.filter("folder = ''").filter(~F.col("name").startswith(".")).select("client_id", "name", F.lit(False).alias("is_dir"))
    rows = dirs.unionByName(own).withColumn("kind", F.when(F.col("is_dir"), 0).otherwise(1)).withColumn("low", F.lower("name"))
    return numbered(rows, "client_id", ["kind", "low", "name"]).select("client_id", "name", (F.col("kind") == 0).alias("is_dir"), "place")


def new_audio(files: DataFrame, ingested: DataFrame, cap: int | None = None) -> DataFrame:
    """Audio files not below ingested_audio and not yet in a manifest, at most cap a client, oldest path first."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = files.filter(ext.isin(*AUDIO) & ~F.contains("path", F.lit("ingested_audio/"))).join(ingested.select("path"), "path", "left_anti")
    if cap is None:
        return found
    return found.withColumn("r", F.row_number().over(Window.partitionBy("client_id").orderBy("path"))).filter(F.col("r") <= cap).drop("r")


def slug_match(wanted: Column, folder: Column) -> Column:
    """3 equal, 2 one contains the other, 1 all parts of the wanted name contained, 0."""
    a, b = X.slug_client(wanted), X.slug_client(folder)
    parts = F.forall(F.split(a, "_"), lambda p: F.contains(b, p))
    return F.when(a == b, 3).when(F.contains(a, b) | F.contains(b, a), 2).when(parts, 1).otherwise(0)


def best_slug(names: list[str], folders: DataFrame, col: str = "name") -> DataFrame:
    """For each asked name the best folder, 0 rejected. Names are what a user typed: a short list, kept in the plan."""
    asked = F.explode(F.array(*map(F.lit, names)))
    f = folders.select(col).distinct().select(F.col(col).alias("folder"), asked.alias("asked")).withColumn("score", slug_match(F.col("asked"), F.col("folder"))).filter("score > 0")
    return f.groupBy("asked").agg(F.min_by("folder", F.struct((-F.col("score")).alias("s"), "folder")).alias("folder"), F.max("score").alias("score"))


def success_and_errors(outcomes: DataFrame) -> DataFrame:
    """The requested clients that were found and ready, and with a message those that were not found."""
    r = outcomes.select("client_id", "outcome")
    return r.filter("outcome = 'success'").unionByName(r.filter("outcome = 'error'").withColumn("message", F.lit("not found")), allowMissingColumns=True)


def bonus(asked: Column, folder: Column) -> Column:
    """What a folded name gains beside its sequence ratio: contained 0.3, at the beginning 0.2, all its words among the
    folder's 0.3 (N14)."""
    i = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    among = (F.size(words(asked)) > 0) & (F.size(F.array_except(words(asked), words(folder))) == 0)
    return i(F.contains(folder, asked), 0.3) + i(folder.startswith(asked), 0.2) + i(among, 0.3)


def search_key(c: Column) -> Column:
    """A name as it is searched: without accents, lower-cased."""
    return F.lower(X.unaccent(c))


def find_clients(names: list[str], folders: DataFrame, col: str = "name", least: float = 0.3, n: int | None = 10) -> DataFrame:
    """The n folders of best fuzzy score for each asked name, all if n is None (N14, J17, F7, T1): sequence ratio and bonuses, at most 1.
    The bonuses are columns; Python takes the ratio of those that can still reach `least`, by the letters that both have. The
    names are what a user typed: a short list, kept in the plan."""

    @F.pandas_udf("double")
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    f = folders.select(F.col(col).alias("folder")).distinct().select("folder", F.explode(F.array(*map(F.lit, names))).alias("asked"))
    f = f.withColumn("_a", search_key(F.col("asked"))).withColumn("_f", search_key(F.col("folder"))).withColumn("_b", bonus(F.col("_a"), F.col("_f")))
    f = f.filter(X.most_alike(F.col("_a"), F.col("_f")) + F.col("_b") >= least).withColumn("score", F.least(F.lit(1.0), ratios("_a", "_f") + F.col("_b"))).filter(F.col("score") >= least).drop("_a", "_f", "_b")
    w = Window.partitionBy("asked").orderBy(F.desc("score"), "folder")
    return f if n is None else f.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def find_client(names: list[str], folders: DataFrame, col: str = "name", exact: bool = False) -> DataFrame:
    """(asked, folder, score, matches): the best folder for each asked name and how many match. An exact search counts
    scores of 0.9 or more and accepts the best at 0.95 or more, else the folder is null (F7)."""
    m = find_clients(names, folders, col, 0.9 if exact else 0.3, None).groupBy("asked").agg(F.min_by(F.struct("folder", "score"), F.struct(-F.col("score"), "folder")).alias("best"), F.count("*").alias("matches"))
    fine = F.col("best.score") >= (0.95 if exact else 0.0)
    return m.select("asked", F.when(fine, F.col("best.folder")).alias("folder"), "best.score", "matches")
