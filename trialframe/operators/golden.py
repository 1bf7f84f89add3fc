"""Golden packets: a stratified sample as a blind labelling document, its manifest, and what may be read back.

A packet is as large as its strata's sizes say, so its text is one value; the sample is drawn without a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators.guards import Refused, agreement_refusal, require_none
from trialframe.operators.split import golden_sample, short_strata


def drawn(df: DataFrame, row_id: str, stratum: str, size: int, seed: int = 7) -> DataFrame:
    """size rows of each stratum, numbered; a stratum with fewer rows is refused."""
    require_none(short_strata(df, stratum, size), f"strata with fewer than {size} rows")
    return golden_sample(df, F.col(row_id), stratum, size, seed)


def rendered_row(number: Column, window: Column, question: str) -> Column:
    """One row of a packet, in the given format of packets."""
    head = F.concat(F.lit("## Row "), number.cast("string"))
    return F.array_join(F.array(head, F.lit(""), F.lit("~~~text"), window, F.lit("~~~"), F.lit(""), F.lit(f"**Q: {question}**"), F.lit(""), F.lit("- Answer (`yes` / `no`): "), F.lit(""), F.lit("---"), F.lit("")), "\n")


def identities_digest(number: Column, row_id: Column) -> Column:
    """An aggregate over a packet's rows: sha256 of the sorted [number, id] pairs as compact JSON."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), row_id.cast("string").alias("i")))), lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit(","), F.to_json(F.array(x["i"])).substr(F.lit(2), F.length(F.to_json(F.array(x["i"]))) - 2), F.lit("]")))
    return F.sha2(F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")).cast("binary"), 256)


def packet(rows: DataFrame, row_id: str, window: str, question: str, header: str) -> DataFrame:
    """One row: packet_md, packet_sha256, rows_sha256, and the gate: n and the strict majority as its floor."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("number", rendered_row(F.col("number"), F.col(window), question).alias("t")))), lambda x: x["t"])
    out = rows.agg(F.array_join(F.concat(F.array(F.lit(header)), text), "\n").alias("packet_md"), identities_digest(F.col("number"), F.col(row_id)).alias("rows_sha256"), F.count("*").alias("n"))
    return out.select("packet_md", F.sha2(F.col("packet_md").cast("binary"), 256).alias("packet_sha256"), "rows_sha256", "n", (F.floor(F.col("n") / 2) + 1).alias("floor"))


def verified(packet_md: str, manifest: DataFrame) -> DataFrame:
    """The manifest if its packet_sha256 is that of the packet, else refused."""
    held = manifest.where(F.col("packet_sha256") == F.sha2(F.lit(packet_md).cast("binary"), 256))
    if held.isEmpty():
        raise Refused("the packet differs from the one that the manifest pins")
    return held


def read_labels(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """(row_id, label) as booleans of filled labels (row, row_id, label), if they cover exactly the manifest's rows.

    Labels for other rows are refused before any is read; a label that is neither yes nor no raises as it is read.
    """
    own = labels.agg(identities_digest(F.col("row"), F.col("row_id")).alias("d")).first().d
    if manifest.where(F.col("rows_sha256") == own).isEmpty():
        raise Refused("labels do not match the manifest's rows")
    odd = F.raise_error(F.concat(F.lit("not yes or no: row "), F.col("row_id").cast("string"))).cast("boolean")
    return labels.select("row_id", F.when(F.col("label") == "yes", True).when(F.col("label") == "no", False).otherwise(odd).alias("label"))


def proved(report: DataFrame, manifest: DataFrame) -> DataFrame:
    """report (n, agree, panel_labels) if it clears the gate of the verified manifest (n, floor), else refused."""
    gate = manifest.select(F.col("n").alias("__n"), F.col("floor").alias("__floor")).first()
    why = report.select(agreement_refusal(F.col("n"), F.col("agree"), F.col("panel_labels"), F.lit(gate["__n"]), F.lit(gate["__floor"])).alias("why")).first().why
    if why:
        raise Refused(f"the panel does not clear the gate: {why}")
    return report


def labels_template(rows: DataFrame, row_id: str) -> DataFrame:
    """(row, row_id, label) to be filled in."""
    return rows.select(F.col("number").alias("row"), F.col(row_id).cast("string").alias("row_id"), F.lit(None).cast("string").alias("label"))


def write_packet(rows: DataFrame, row_id: str, stratum: str, window: str, question: str, header: str, root: str) -> None:
    """packet, labels_template and manifest below root, each a folder: text, JSON lines and one JSON object."""
    made = packet(rows, row_id, window, question, header)
    made.select(F.col("packet_md").alias("value")).write.text(f"{root}/packet")
    labels_template(rows, row_id).coalesce(1).write.option("ignoreNullFields", "false").json(f"{root}/labels_template")
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("number").alias("row"), F.col(row_id).cast("string").alias("row_id"), F.col(stratum).alias("stratum")))).alias("rows"))
    made.drop("packet_md").crossJoin(F.broadcast(listed)).write.json(f"{root}/manifest")  # one row each


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest below root; anything but one object with all its fields raises."""
    schema = "packet_sha256 string, rows_sha256 string, n long, floor long, rows array<struct<row:int,row_id:string,stratum:string>>"
    held = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/manifest")
    if held.where("packet_sha256 is not null and rows_sha256 is not null and n is not null and floor is not null").count() != 1:
        raise Refused(f"{root} has no manifest")
    return held
