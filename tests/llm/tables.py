"""Small tables in the layout of the test data, written to a folder."""

from __future__ import annotations

SCHEMAS = {
    "labels": "sample_id long, path string, split string, source string, category string, category_id int, label int, `group` string, form_factor string, orientation string, kind string, is_competitor string, has_boundbox string",
    "export_manifest": "sample_id long, arquivo string, split string, source string, category string, category_id int, label int, tipos_erro string, parent string, origem string, orig_source string, kind string",
    "pool_manifest": "pool_id long, batch_no int, path string, source string, `group` string, phash long",
    "emb_cache": "vec_id long, emb array<float>, label long, category string, `group` string, path string, parent string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, id long, key string",
    "eval_passages": "item_id long, split string, lang string, text string",
    "quota_targets": "category string, form_factor string, target_share double, min_rows int",
    "mix_targets": "source string, weight double, max_repeat int",
}


def write(spark, folder, **tables):
    """Write the given rows (dicts, missing columns null) and empty tables for the rest."""
    for name, ddl in SCHEMAS.items():
        schema = spark.createDataFrame([], ddl).schema
        rows = [tuple(row.get(f.name) for f in schema) for row in tables.get(name, ())]
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
