"""Document packages, published trees and third-party inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


CONTENT_TYPES = "[Content_Types].xml"


def resolved(base: Column, target: Column) -> Column:
    """A relationship target as a part name: rooted when it starts with ``/``,
    else relative to ``base``, with ``.`` and ``..`` folded."""
    joined = F.when(base == "", target).otherwise(F.concat(base, F.lit("/"), target))

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg.isin("", "."), acc)
            .when(seg == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)))
            .otherwise(F.concat(acc, F.array(seg)))
        )

    folded = F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(folded)


def rels_owner_dir(rels_name: Column) -> Column:
    """``word/_rels/document.xml.rels`` describes ``word``."""
    return F.when(F.contains(rels_name, F.lit("/_rels/")), F.regexp_extract(rels_name, "^(.*)/_rels/[^/]*$", 1)).otherwise("")


def rels_name_for(part: Column) -> Column:
    return F.when(
        F.contains(part, F.lit("/")), F.regexp_replace(part, "^(.*)/([^/]*)$", "$1/_rels/$2.rels")
    ).otherwise(F.concat(F.lit("_rels/"), part, F.lit(".rels")))


def package_problems(parts: DataFrame, overrides: DataFrame, defaults: DataFrame, rels: DataFrame, uses: DataFrame) -> DataFrame:
    """(package_id, rule, item) for broken packages.

    ``parts`` (package_id, name), ``overrides`` (package_id, part_name),
    ``defaults`` (package_id, extension), ``rels`` (package_id, rels_name,
    rel_id, target, external), ``uses`` (package_id, part, rel_id).

    Each input is read once: its rows say what they name (a part, or a
    relationship), as what, and under which item it is reported if nobody
    answers for the name. They are sent once, by package and name, as little
    more than that name; rows alike are counted where they arrive, and rule and
    item are written out at the end. A repeated row is reported as often as it
    stands; a null names nothing.
    """
    none = F.lit(None).cast("string")

    def fact(name: Column, as_: str, said: Column = none) -> Column:
        return F.struct(name.alias("name"), F.lit(as_).alias("as"), said.alias("said"))

    part = parts.select("package_id", fact(F.col("name"), "part").alias("f"))
    declared = overrides.select("package_id", fact(F.ltrim("part_name", F.lit("/")), "declared", F.col("part_name")).alias("f"))
    to = F.when(~F.col("external"), resolved(rels_owner_dir(F.col("rels_name")), F.col("target")))
    targets = F.when(~F.col("external"), fact(F.col("to"), "target", F.col("target")))
    known = fact(F.concat("rels_name", F.lit("\0"), "rel_id"), "known")
    related = rels.withColumn("to", to).select("package_id", F.explode(F.array_compact(F.array(known, targets))).alias("f"))
    wanted = F.concat(rels_name_for(F.col("part")), F.lit("\0"), F.col("rel_id"))
    used = uses.select("package_id", fact(wanted, "used", F.concat_ws(": ", "part", "rel_id")).alias("f"))

    same = Window.partitionBy("package_id", "name", "relationship")
    facts = (
        part.unionByName(declared).unionByName(related).unionByName(used).select("package_id", "f.*")
        .repartition("package_id", "name")
        .groupBy("package_id", "name", "as", "said").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("relationship", F.col("as").isin("known", "used"))
        .withColumns({kind: F.bool_or(F.col("as") == kind).over(same) for kind in ("part", "declared", "known")})
    )
    met = F.when(F.col("as") == "part", F.col("declared")).when(F.col("as") == "used", F.col("known")).otherwise(F.col("part"))
    named = F.col("package_id").isNotNull() & F.col("name").isNotNull()
    open_ = facts.where("as <> 'known'").where(~(met & named)).where(
        (F.col("as") != "part") | (F.col("name") != CONTENT_TYPES)
    ).select("package_id", "name", "as", "said", "n")
    # a part may be declared by its extension; other rows carry one that no default can have
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("name", "said"), F.lit(1000)))
    extension = F.when(F.col("as") == "part", F.regexp_extract("name", r"([^.]*)$", 1)).otherwise(spread)
    by_extension = defaults.select("package_id", "extension").distinct().withColumn("listed", F.lit(True))
    rules = {"part": "undeclared part", "declared": "declared but missing", "target": "dangling target", "used": "undeclared relationship"}
    rule = F.coalesce(*[F.when(F.col("as") == k, v) for k, v in rules.items()])
    item = F.when(F.col("as") == "part", F.col("name")).when(F.col("as") == "target", F.concat_ws(" -> ", "said", "name")).otherwise(F.col("said"))
    return (
        open_.withColumn("extension", extension).join(by_extension, ["package_id", "extension"], "left").where("listed IS NULL")
        .select("package_id", rule.alias("rule"), item.alias("item"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("time"))
        .select("package_id", "rule", "item")
    )


def path_rules(paths: DataFrame) -> DataFrame:
    """(path, rule): every rule that could cover a path, which is the path
    itself and each folder above it, so matching is an equi-join."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    candidates = F.concat(F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>")), F.array("path"))
    return paths.select("path", F.explode(candidates).alias("rule"))


def publication(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, status) by rules (rule, list): ``withheld`` wins over ``public``,
    a path on neither list is ``unclassified``."""
    lists = rules.select("rule", "list").distinct()
    matched = path_rules(paths).join(lists, "rule")
    status = matched.groupBy("path").agg(
        F.when(F.bool_or(F.col("list") == "withheld"), "withheld").otherwise("public").alias("status")
    )
    return paths.select("path").join(status, "path", "left").select("path", F.coalesce("status", F.lit("unclassified")).alias("status"))


def dead_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that cover no path."""
    return rules.join(path_rules(paths).select("rule").distinct(), "rule", "left_anti").select("rule", "list")


def payload_digests(files: DataFrame) -> DataFrame:
    """(set_id, files, digest) of sets of files (set_id, path, executable, content).

    The digest runs over path, NUL, mode, NUL and the content's own hash, in
    path order. Contents are hashed where they are; what is gathered per set is
    a path and 32 bytes for each file of one released tree.
    """
    nul = F.lit(b"\x00")
    mode = F.when(F.col("executable"), "100755").otherwise("100644")
    entry = F.concat(
        F.encode("path", "utf-8"), nul, F.encode(mode, "utf-8"), nul, F.unhex(F.sha2("content", 256))
    )
    listed = F.expr("listagg(entry) WITHIN GROUP (ORDER BY path)")
    return files.select("set_id", "path", entry.alias("entry")).groupBy("set_id").agg(
        F.count(F.lit(1)).alias("files"), F.sha2(listed, 256).alias("digest")
    )


def package_inventory(packages: DataFrame) -> DataFrame:
    """One row per name and version over all targets (name, version, license,
    repository, target), the last target's figures standing; no licence is ``UNKNOWN``."""
    order = F.struct("target", F.coalesce("license", F.lit("")).alias("license"), F.coalesce("repository", F.lit("")).alias("repository"))
    return packages.groupBy("name", "version").agg(F.max(order).alias("p")).select(
        "name", "version", F.coalesce(F.nullif(F.col("p.license"), F.lit("")), F.lit("UNKNOWN")).alias("license"),
        F.regexp_replace(F.regexp_replace("p.repository", r"^git\+", ""), r"\.git$", "").alias("repository"),
    )


def inventory_summary(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("packages"), F.count_if(F.col("license").rlike("UNKNOWN|UNREADABLE")).alias("unknown")
    )


def unlisted_dependencies(direct: DataFrame, inventory: DataFrame) -> DataFrame:
    return direct.join(inventory.select("name").distinct(), "name", "left_anti")
