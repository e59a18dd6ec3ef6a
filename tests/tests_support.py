"""Landing files for stream tests."""

from contentflow import schemas


def land(spark, root, *docs):
    names = schemas.columns(schemas.RAW_FETCH)
    rows = [{"status": 200, "url": "https://e.org/feed", "content_type": "text/html", **d} for d in docs]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.RAW_FETCH).coalesce(1).write.mode("append").parquet(f"{root}/landing")
