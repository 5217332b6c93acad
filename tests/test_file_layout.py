"""Files grow with the data, not with the number of batches or log segments."""

from pyspark.sql import functions as F

from obslake.sources import logs as LG
from obslake.sources import segments as S


def test_batches_of_a_day_share_files(spark, tmp_path):
    rows = spark.range(600).select(F.lit("s").alias("source_id"), F.concat(F.lit("2024-01-0"), F.col("id") % 2 + 1).alias("day"), F.lit("target").alias("scope"), F.concat(F.lit("t"), F.col("id") % 40).alias("target_id"), F.lit("internal").alias("privacy_class"), F.lit("event").alias("record_type"), F.concat(F.lit("r"), "id").alias("record_id"), F.lit("{}").alias("line"))
    S.write(*S.build(rows, ["record_id"], 5), str(tmp_path / "segments"))
    head, body, bad = S.scan(spark, str(tmp_path / "segments"))
    assert (head.count(), body.count(), bad.count(), S.audit(head, body).where("code IS NOT NULL").count()) == (120, 600, 0, 0)
    assert len(list((tmp_path / "segments").rglob("*.txt"))) <= 2 * S.FILES


def test_log_segments_share_files_and_keep_their_order(spark, tmp_path):
    lines = spark.range(300).select(F.concat(F.lit("u"), F.col("id") % 100).alias("segment"), F.floor(F.col("id") / 100).cast("int").alias("n"), F.concat(F.lit('{"a":"'), "id", F.lit('\\n"}')).alias("value"))
    LG.write(lines, str(tmp_path / "logs"))
    back = LG.scan(spark, str(tmp_path / "logs"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lines.collect()))
    assert len(list((tmp_path / "logs").rglob("*.txt"))) < 100
