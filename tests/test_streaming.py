from pyspark.sql import functions as F

from carecolumns.sources.definitions import specifications
from carecolumns.streaming import formula_stream, windowed


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (100 + F.col("id") % 60).alias("na"), F.lit(90).alias("cl"), (F.col("id") % 31).alias("hco3"))
    rows.write.parquet(str(tmp_path / "in"))
    spec = specifications()["anion-gap"]
    stream = windowed(formula_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), spec), "ts", "ag")
    query = stream.writeStream.format("memory").queryName("anion").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = windowed(formula_stream(spark.read.parquet(str(tmp_path / "in")), spec), "ts", "ag")
    assert sorted(map(tuple, spark.table("anion").collect())) == sorted(map(tuple, want.collect())) != []
