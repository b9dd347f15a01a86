"""Catalog queries: documents stand for files, their language for the folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import catalog
from corvane.plans.registry import query, table

EXTS = ["wav", "MP3", "flac", "ogg", "m4a", "txt"]

FILES = f"""files AS (
    SELECT doc_id AS id, 'train/' || CASE WHEN source = 'src0' THEN 'Noise' ELSE lang || '_' || source END || '/f' || doc_id || '.' || {EXTS!r}[doc_id % 6 + 1] AS path FROM documents
)"""
ORDER = "(((id + 1) * 1103515245 + {seed} * 12345) % 2147483647) * 48271 % 2147483647"
CATALOG = f"""{FILES}, cat AS (SELECT id, path, split_part(path, '/', 2) AS label FROM files WHERE path NOT LIKE '%.txt')"""
CLASSES = f"""{CATALOG}, classes AS (SELECT row_number() OVER (ORDER BY label) - 1 AS class_idx, label AS class FROM (SELECT DISTINCT label FROM cat WHERE label <> 'Noise'))"""


def files(spark, sf_dir):
    label = F.when(F.col("source") == "src0", "Noise").otherwise(F.concat_ws("_", "lang", "source"))
    ext = F.get(F.array(*map(F.lit, EXTS)), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("train/"), label, F.lit("/f"), "doc_id", F.lit("."), ext).alias("path"))


def full(spark, sf_dir):
    return catalog.file_catalog(files(spark, sf_dir))


@query(f"""WITH {CATALOG}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORDER.format(seed=42)}, id) AS k FROM cat WHERE label IN ('en_src1', 'fr_src2', 'Noise'))
    SELECT id, path, label FROM k WHERE k <= 5""")
def s1_file_catalog(spark, sf_dir):
    """Recordings of some classes and noise, five of each at most."""
    return catalog.file_catalog(files(spark, sf_dir), ["en_src1", "fr_src2"], most=5)


@query(f"WITH {CATALOG} SELECT right(path, 4) AS ext, count(*) AS n FROM cat GROUP BY ALL")
def s2_extensions(spark, sf_dir):
    return full(spark, sf_dir).groupBy(F.expr("right(path, 4)").alias("ext")).agg(F.count("*").alias("n"))


@query(f"WITH {FILES} SELECT id, path FROM files WHERE lower(path) LIKE '%.wav' ORDER BY path LIMIT 20")
def s7_flat_wav_scan(spark, sf_dir):
    """One kind of file, the first 20 by name: a limit that is the feature."""
    return files(spark, sf_dir).where(catalog.has_extension(F.col("path"), [".wav"])).orderBy("path").limit(20)


@query("WITH w AS (SELECT trim(' ' || source || CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE '' END) AS species FROM documents UNION ALL SELECT '') SELECT DISTINCT species FROM w WHERE length(species) > 0")
def s8_species_list(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.concat(F.lit(" "), "source", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise("")).alias("value"))
    return catalog.species_list(lines.unionByName(spark.createDataFrame([("   ",)], "value string")))


@query(f"WITH {CATALOG} SELECT id, label FROM cat")
def f1_label_from_path(spark, sf_dir):
    return full(spark, sf_dir).select("id", "label")


@query(f"WITH {CATALOG} SELECT label, count(*) AS n FROM cat WHERE lower(label) IN ('noise', 'silence', 'background', 'other') GROUP BY label")
def f2_noise(spark, sf_dir):
    return full(spark, sf_dir).where(catalog.is_noise(F.col("label"))).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {CATALOG} SELECT id, path, label FROM cat WHERE label IN ('en_src1', 'de_src3', 'Noise')")
def f3_known_classes(spark, sf_dir):
    return catalog.file_catalog(files(spark, sf_dir), ["en_src1", "de_src3"])


@query(f"WITH {CLASSES} SELECT id, class_idx::INT AS class_idx, CASE WHEN class = label THEN 1 ELSE 0 END AS y FROM cat, classes")
def f4_one_hot(spark, sf_dir):
    rows = full(spark, sf_dir)
    return catalog.one_hot(rows, catalog.class_names(rows))


@query(f"""WITH {CATALOG}, n AS (SELECT d.doc_id AS id, d.n_chars // 1000 AS n_chunks FROM documents d)
    SELECT id, label, n_chunks FROM cat JOIN n USING (id) WHERE label <> 'Noise' AND n_chunks > 0""")
def f5_evaluated_files(spark, sf_dir):
    """Files of a class that have chunks."""
    rows = full(spark, sf_dir)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("n_chars") / 1000).alias("n_chunks"))
    return catalog.label_index(rows, catalog.class_names(rows)).join(sizes, "id").where("n_chunks > 0").select("id", "label", "n_chunks")


@query("SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'librosa' WHEN 1 THEN 'raw' WHEN 2 THEN 'Hybrid' ELSE 'librosa' END) AS frontend FROM documents")
def f9_frontend_alias(spark, sf_dir):
    given = F.get(F.array(*map(F.lit, ["precomputed", "tf", "Hybrid", "LIBROSA"])), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", catalog.frontend(given).alias("frontend"))


@query(f"WITH {CLASSES} SELECT id, path, label, class_idx::INT AS class_idx FROM cat JOIN classes ON label = class")
def j1_label_index(spark, sf_dir):
    rows = full(spark, sf_dir)
    return catalog.label_index(rows, catalog.class_names(rows))


@query(f"""WITH {CLASSES}, k AS (SELECT DISTINCT id FROM cat)
    SELECT k.id, class_idx::INT AS class_idx, coalesce(max(CASE WHEN cat.label = classes.class THEN 1 END), 0)::INT AS y FROM k CROSS JOIN classes LEFT JOIN cat ON cat.id = k.id GROUP BY ALL""")
def j2_file_class_grid(spark, sf_dir):
    """The grid of files and classes: one side is the list of classes."""
    rows = full(spark, sf_dir)
    return catalog.one_hot(rows, catalog.class_names(rows))


@query(f"WITH {CATALOG} SELECT label, count(*) AS n FROM cat WHERE label <> 'Noise' GROUP BY label ORDER BY n DESC, label LIMIT 25")
def a1_most_frequent_classes(spark, sf_dir):
    return catalog.most_frequent_classes(full(spark, sf_dir))


@query(f"""WITH {CLASSES}, n AS (SELECT class, count(id) AS n FROM classes LEFT JOIN cat ON label = class GROUP BY class)
    SELECT class, round(sum(n) OVER () / (count(*) OVER () * greatest(n, 1)), 6) AS weight FROM n""")
def a6_class_weights(spark, sf_dir):
    rows = full(spark, sf_dir)
    return catalog.class_weights(rows, catalog.class_names(rows)).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {CLASSES}, n AS (SELECT class, count(*) AS n FROM classes JOIN cat ON label = class GROUP BY class)
    SELECT class, n, greatest(0, floor(max(n) OVER () * 0.75)::BIGINT - n) AS deficit FROM n""")
def a7_upsample_target(spark, sf_dir):
    rows = full(spark, sf_dir)
    return catalog.upsample_deficits(rows, catalog.class_names(rows), 0.75)


UP = f"""{CLASSES}, n AS (SELECT class, count(*) AS n FROM classes JOIN cat ON label = class GROUP BY class),
    d AS (SELECT class, n, greatest(0, floor(max(n) OVER () * 0.75)::BIGINT - n) AS deficit FROM n),
    g AS (SELECT class, n, unnest(range(1, deficit + 1)) AS copy FROM d WHERE deficit > 0),
    h AS (SELECT class, copy, ((((copy + 1) * 1103515245 + 42 * 12345) % 2147483647) * 48271 % 2147483647) % n AS place FROM g),
    p AS (SELECT id, path, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS place FROM cat)"""


@query(f"""WITH {UP} SELECT id, path, label, 0::BIGINT AS copy FROM cat WHERE label <> 'Noise'
    UNION ALL SELECT id, path, label, copy FROM h JOIN p ON p.label = h.class AND p.place = h.place""")
def k8_upsampled(spark, sf_dir):
    rows = full(spark, sf_dir)
    return catalog.upsampled(rows, catalog.class_names(rows), 0.75)


@query(f"WITH {CATALOG}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORDER.format(seed=7)}, id) AS k FROM cat) SELECT id, path, label FROM k WHERE k <= 3")
def k5_class_cap(spark, sf_dir):
    return catalog.file_catalog(files(spark, sf_dir), most=3, seed=7)


@query(f"""WITH {CATALOG}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORDER.format(seed=42)}, id) AS k FROM cat),
    s AS (SELECT id, path, label FROM k WHERE k <= greatest(1, 120 // (SELECT count(DISTINCT label) FROM cat)))
    SELECT * FROM s ORDER BY {ORDER.format(seed=43)}, id LIMIT 120""")
def k6_stratified_sample(spark, sf_dir):
    return catalog.stratified(full(spark, sf_dir), 120)


@query(f"""WITH {CATALOG}, k AS (SELECT *, row_number() OVER (ORDER BY {ORDER.format(seed=42)}, id) AS k, count(*) OVER () AS n FROM cat)
    SELECT id, CASE WHEN k <= floor(n * (1 - 0.2)) THEN 'train' ELSE 'validation' END AS part FROM k""")
def k7_train_validation_split(spark, sf_dir):
    return catalog.split(full(spark, sf_dir), 0.2).select("id", "part")


@query("""WITH l AS (SELECT doc_id % 3 AS list, doc_id AS place, source || '_' || lang AS species FROM documents),
    f AS (SELECT list, species, min(place) AS place FROM l GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY place) AS turn FROM f),
    g AS (SELECT species, min(turn * 1000 + list) AS pos FROM t GROUP BY species) SELECT species FROM (SELECT * FROM g ORDER BY pos LIMIT 30)""")
def u1_combined_species(spark, sf_dir):
    lists = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("list"), F.col("doc_id").alias("place"), F.concat_ws("_", "source", "lang").alias("species"))
    return catalog.combined_species(lists, 30)


@query("SELECT DISTINCT trim(source) AS species FROM documents ORDER BY 1")
def u2_distinct_species(spark, sf_dir):
    return catalog.species_list(table(spark, sf_dir, "documents").select(F.col("source").alias("value")))


@query("""SELECT a.vec_id, list_transform(range(1, 11), lambda i: greatest(CASE WHEN a.label = i - 1 THEN 1 ELSE 0 END, CASE WHEN b.label = i - 1 THEN 1 ELSE 0 END))::INT[]::VARCHAR AS labels
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def u3_label_union(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int")).alias("y"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("y").alias("z"))
    return rows.join(other, "vec_id").select("vec_id", F.concat(F.lit("["), F.array_join(F.zip_with("y", "z", lambda a, b: F.greatest(a, b)), ", "), F.lit("]")).alias("labels"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), 'default') AS value FROM documents")
def u4_layered_settings(spark, sf_dir):
    first, second = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", catalog.layered(first, second, F.lit("default")).alias("value"))
