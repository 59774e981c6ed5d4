"""Published generations: documents and rejections as JSON lines, a manifest with digests and counts, and its contract.

A digest adds and XORs 64-bit hashes of the rows, so it depends on no order and is made in one distributed pass.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from . import store

VERSIONS = {"schema_version": "1.0", "pipeline_version": "1.3"}


def digest(df: DataFrame) -> DataFrame:
    """One row ``records, digest`` of the rows of ``df``, whatever their order; columns count in the order of their names."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    parts = df.select(h.alias("h")).agg(F.count("*").alias("records"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s"))
    return parts.select("records", F.sha2(F.concat_ws("|", F.col("records").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")), 256).alias("digest"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(documents: DataFrame, rejections: DataFrame, audit: DataFrame, root: str, run_id: str) -> str:
    """Write a generation that is never changed: outputs, audit and, last, its manifest. An existing one is an error."""
    spark = documents.sparkSession
    base = f"{root.rstrip('/')}/generations/{run_id}"
    fs, p = _fs(spark, base)
    if fs.exists(p):
        raise FileExistsError(base)
    outputs = {}
    for name, df in (("documents", documents), ("rejections", rejections)):
        df.select(*sorted(df.columns)).write.mode("errorifexists").json(f"{base}/{name}")
        d = digest(df).first()
        outputs[name] = {"path": name, "records": d.records, "digest": d.digest, "schema": df.select(*sorted(df.columns)).schema.jsonValue()}
    audit.write.mode("errorifexists").json(f"{base}/audit")
    gates = [r.asDict() for r in audit.limit(1).collect()]
    manifest = {"run_id": run_id, **VERSIONS, "outputs": outputs, "audit_passed": bool(gates and gates[0].get("passed"))}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{base}/manifest")
    return base


def read_manifest(spark: SparkSession, base: str) -> dict:
    return json.loads(spark.read.text(f"{base}/manifest").first().value)


def read_output(spark: SparkSession, base: str, name: str) -> DataFrame:
    from pyspark.sql.types import StructType

    out = read_manifest(spark, base)["outputs"][name]
    return spark.read.schema(StructType.fromJson(out["schema"])).json(f"{base}/{out['path']}")


def contract_faults(spark: SparkSession, base: str) -> list[str]:
    """What a generation breaks: versions, outputs, counts and digests, empty or repeated ids, runs of other names, gates."""
    m = read_manifest(spark, base)
    faults = [k for k, v in VERSIONS.items() if m.get(k) != v]
    if set(m.get("outputs", {})) != {"documents", "rejections"}:
        return [*faults, "outputs"]
    for name, out in m["outputs"].items():
        if out["path"] != name:
            faults.append(f"{name}_path")
            continue
        d = digest(read_output(spark, base, name)).first()
        faults += [f"{name}_{k}" for k, v in (("records", d.records), ("digest", d.digest)) if out[k] != v]
    docs = read_output(spark, base, "documents")
    run = F.col("run_id") if "run_id" in docs.columns else F.lit(m["run_id"])
    c = docs.agg(
        F.count_if(F.coalesce("document_id", F.lit("")) == "").alias("empty_ids"),
        (F.count("document_id") - F.count_distinct("document_id")).alias("repeated_ids"),
        F.count_if(~run.eqNullSafe(F.lit(m["run_id"]))).alias("other_runs"),
    ).first()
    faults += [k for k, n in c.asDict().items() if n]
    return faults + ([] if m.get("audit_passed") else ["audit"])


def import_generation(target: DataFrame, base: str) -> DataFrame:
    """The flat documents of a valid generation into ``target``; one that breaks its contract is an error."""
    faults = contract_faults(target.sparkSession, base)
    if faults:
        raise ValueError(f"generation is not valid: {', '.join(faults)}")
    docs = read_output(target.sparkSession, base, "documents")
    docs = docs.select(*(c for c in docs.columns if c in target.columns))
    return store.upsert(target, docs, "document_id", [c for c in docs.columns if c not in ("document_id", "category_ids")])


def simplified(c: Column, traditional: str = "", simple: str = "") -> Column:
    """Characters of one script variant as those of the other, by the caller's table; without one the text stays."""
    return F.translate(c, traditional, simple) if traditional else c


def documents_export(docs: DataFrame, traditional: str = "", simple: str = "") -> DataFrame:
    """``id, title, content`` of every document, NULL as ''."""
    shown = lambda c: simplified(F.coalesce(c, F.lit("")), traditional, simple).alias(c)
    return docs.select(F.col("document_id").alias("id"), shown("title"), shown("content"))


def document_index(docs: DataFrame, pos: str = "doc_id") -> DataFrame:
    """One row per document_id: of several the last."""
    cols = [c for c in docs.columns if c != "document_id"]
    last = docs.where(text.stripped(F.col("document_id")) != "").groupBy("document_id").agg(F.max_by(F.struct(*cols), pos).alias("_d"))
    return last.select("document_id", "_d.*")


def insert_facts(triples: DataFrame, evidence: DataFrame, batch: DataFrame, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(triples, evidence) after a batch: facts of new keys get the next ids in batch order, every valid row of the batch
    gives evidence for its fact, old or new, unless the fact has it.

    Keys with a NULL part are never equal to another, so each such row is a fact of its own.
    """
    valid = " AND ".join(f"coalesce({c}, '') <> ''" for c in ("subject", "relation", "object"))
    b = batch.where(valid)
    new = store.insert_or_ignore(triples, b, pos)
    top = triples.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # ids continue by a range-partitioned order, so no task numbers all rows
    cut = new.repartitionByRange(pos).sortWithinPartitions(pos).withColumn("_part", F.spark_partition_id())
    sizes = cut.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(pos))
    numbered = cut.withColumn("_local", local).join(F.broadcast(before), "_part").join(F.broadcast(top))  # one row
    numbered = numbered.withColumn("id", F.col("top") + F.col("_before") + F.col("_local"))
    key = list(store.FACT_KEY)
    facts = triples.select("id", *key).unionByName(numbered.select("id", *key))
    whole = facts.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    of_keys = b.join(whole, key).select(F.col("id").alias("triple_id"), "source_document_id", "source_text")
    # a row without an object type is the fact it was inserted as
    alone = numbered.where(" OR ".join(f"{k} IS NULL" for k in key)).select(F.col("id").alias("triple_id"), "source_document_id", "source_text")
    cols = ["triple_id", "source_document_id", "source_text"]
    proof = of_keys.union(alone).dropDuplicates(cols)
    have = evidence.select(*cols)
    proof = proof.join(have.where(" AND ".join(f"{c} IS NOT NULL" for c in cols)), cols, "left_anti").select(*cols)
    return triples.unionByName(numbered.select([c for c in triples.columns if c in numbered.columns]), allowMissingColumns=True), have.unionByName(proof)


def cleared(triples: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables empty: evidence never outlives its facts."""
    return triples.limit(0), evidence.limit(0)
