"""Indented JSON texts: they parse back, and escapes are as stated."""

import json

from pyspark.sql import functions as F

from paperloom.functions.json_text import pretty


def test_pretty(spark):
    rows = [(1, 'a"b\\c/d\n\t\x01 é 😀', 1.0, True, [(1, "x"), (2, None)]), (None, None, 0.25, False, []), (3, "", None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, score double, ok boolean, items array<struct<k: int, v: string>>")
    df = df.select(F.struct("*").alias("v"))
    got = [r.t for r in df.select(pretty(F.col("v"), df.schema["v"].dataType).alias("t")).collect()]
    for text, row in zip(got, rows, strict=True):
        want = dict(zip(("id", "text", "score", "ok"), row[:4], strict=True)) | {"items": row[4] and [dict(zip(("k", "v"), x, strict=True)) for x in row[4]]}
        want["items"] = [] if row[4] == [] else want["items"]
        assert json.loads(text) == want and text.isascii()
        # python's own printer has the same layout, but for slashes
        assert text.replace("\\/", "/").replace('"score": 1,', '"score": 1.0,') == json.dumps(want, indent=4)
