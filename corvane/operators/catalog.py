"""Catalogs of class-structured files: labels, classes, caps, splits, weights, species lists.

Anything random is ordered by integer arithmetic on a key and a seed, so that any engine and any number
of partitions give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.numbering import numbered
from corvane.session import estimated_bytes

# The extensions of recordings, and the labels that stand for noise.
EXTENSIONS = [".wav", ".mp3", ".flac", ".ogg", ".m4a"]
NOISE = ["noise", "silence", "background", "other"]


def order_key(key: Column, seed: int = 42) -> Column:
    """A pseudo-random order of non-negative integer keys."""
    return (((key + 1) * 1103515245 + seed * 12345) % 2147483647) * 48271 % 2147483647


def label_of(path: Column) -> Column:
    """The name of the folder a path is in."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def is_noise(label: Column) -> Column:
    return F.lower(label).isin(NOISE)


def has_extension(path: Column, extensions: list[str] = EXTENSIONS) -> Column:
    return reduce(lambda a, b: a | b, (F.endswith(F.lower(path), F.lit(e)) for e in extensions))


def file_catalog(paths: DataFrame, classes: list[str] | None = None, most: int | None = None, key: str = "id", seed: int = 42, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """Rows of `paths` (key, path) that are recordings, with `label`: of `classes` or noise where those are given, `most` per label."""
    out = paths.where(has_extension(F.col("path"), extensions)).withColumn("label", label_of(F.col("path")))
    if classes is not None:
        out = out.where(F.col("label").isin(classes) | is_noise(F.col("label")))
    if most is not None:
        place = Window.partitionBy("label").orderBy(order_key(F.col(key), seed), key)
        out = out.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= most).drop("__place")
    return out


def class_names(catalog: DataFrame) -> DataFrame:
    """class_idx, class: the labels that are not noise, sorted. A bounded table: one row per class."""
    names = catalog.select(F.col("label").alias("class")).where(~is_noise(F.col("class"))).distinct()
    return names.select((F.row_number().over(Window.orderBy("class")) - 1).alias("class_idx"), "class")


def most_frequent_classes(catalog: DataFrame, n: int = 25, include_noise: bool = False) -> DataFrame:
    """label, n of the n largest classes; names decide ties."""
    rows = catalog if include_noise else catalog.where(~is_noise(F.col("label")))
    return rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def class_weights(catalog: DataFrame, classes: DataFrame) -> DataFrame:
    """class, weight: files of all classes over classes times the class's files (1 if it has none)."""
    counts = catalog.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("n"))
    each = classes.select("class").join(counts, "class", "left")
    whole = each.agg(F.sum(F.coalesce("n", F.lit(0))).alias("total"), F.count("*").alias("k"))
    return each.join(F.broadcast(whole)).select("class", (F.col("total") / (F.col("k") * F.coalesce("n", F.lit(1)))).alias("weight"))


def upsample_deficits(catalog: DataFrame, classes: DataFrame, ratio: float = 0.25) -> DataFrame:
    """class, n, deficit: how many repeats bring each class to the ratio of the largest."""
    counts = catalog.join(classes, catalog["label"] == classes["class"]).groupBy("class").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top)).select("class", "n", F.greatest(F.lit(0), F.floor(F.col("top") * ratio) - F.col("n")).cast("long").alias("deficit"))


def upsampled(catalog: DataFrame, classes: DataFrame, ratio: float = 0.25, key: str = "id", seed: int = 42) -> DataFrame:
    """The classes' files (noise goes), with repeats up to the ratio of the largest class; `copy` is 0 for the files themselves."""
    own = catalog.join(classes, catalog["label"] == classes["class"], "left_semi")
    deficits = upsample_deficits(catalog, classes, ratio).where("deficit > 0")
    short = own.join(deficits.select("class"), own["label"] == deficits["class"])
    places = numbered(short, ["label"], [F.col(key)]).withColumn("place", F.col("place") - 1)
    draws = deficits.select("class", "n", F.explode(F.sequence(F.lit(1), F.col("deficit"))).alias("copy"))
    draws = draws.select("class", "copy", (order_key(F.col("copy"), seed) % F.col("n")).alias("place"))
    again = places.join(draws, ["class", "place"]).select(*own.columns, "copy")
    return own.withColumn("copy", F.lit(0).cast("long")).unionByName(again)


def stratified(catalog: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """`n` files at most, the same number of each label."""
    labels = catalog.select("label").distinct().count()
    place = Window.partitionBy("label").orderBy(order_key(F.col(key), seed), key)
    kept = catalog.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= max(1, n // max(1, labels))).drop("__place")
    return kept.orderBy(order_key(F.col(key), seed + 1), key).limit(n)


#: Rows of the range with the cut that are sorted.
SPLIT_ROWS = 100_000


def split(catalog: DataFrame, validation: float, key: str = "id", seed: int = 42) -> DataFrame:
    """`catalog` with `part`: train for exactly the first int(n (1 - validation)) files of the order, validation for the others.

    The cut is found by rank: the order's keys are counted by range first, so that only the range with
    the cut is sorted. Keys are unique up to ties of `order_key`, which `key` breaks.
    """
    n = catalog.count()
    wanted = int(n * (1 - validation))
    place = order_key(F.col(key), seed)
    low, width, before = 0, 2147483647 // 1024 + 1, 0
    while True:  # the cut's range is cut again until it holds few rows, or one place
        counts = dict(catalog.where(place.between(low, low + 1024 * width - 1)).groupBy(F.floor((place - low) / width).alias("r")).count().collect())  # 1,024 rows at most
        cut = 0
        while cut < 1024 and before + counts.get(cut, 0) <= wanted:
            before += counts.get(cut, 0)
            cut += 1
        low += cut * width
        if counts.get(cut, 0) <= SPLIT_ROWS or width == 1:
            break
        width = width // 1024 + 1
    edge = catalog.where(place.between(low, low + width - 1)).orderBy(place, key).limit(wanted - before).agg(F.max(F.struct(place.alias("o"), F.col(key).alias("k"))).alias("m")).first()["m"]
    train = place < low
    if edge is not None:
        train = train | (place < edge["o"]) | ((place == edge["o"]) & (F.col(key) <= edge["k"]))
    return catalog.withColumn("part", F.when(train, "train").otherwise("validation"))


#: Bytes that class names may be expected to have to be sent to all tasks in one row, and classes of a block beyond that.
NAMES_BYTES, BLOCK_CLASSES = 16_000_000, 10_000


def one_hot(labels: DataFrame, classes: DataFrame, key: str = "id") -> DataFrame:
    """key, class_idx, y for each file and class: all 0 for noise; files of other labels are dropped.

    The names go to all tasks while the planner expects them to be few; beyond that files meet blocks of names by a join."""
    known = labels.join(classes.select(F.col("class").alias("__c")), F.col("label") == F.col("__c"), "left").where(F.col("__c").isNotNull() | is_noise(F.col("label"))).drop("__c")
    few = estimated_bytes(classes) <= NAMES_BYTES
    blocks = classes.withColumn("__block", F.lit(0) if few else F.floor(F.col("class_idx") / BLOCK_CLASSES).cast("int"))
    names = blocks.groupBy("__block").agg(F.array_sort(F.collect_list(F.struct("class_idx", "class"))).alias("names"))
    if few:
        wide = known.crossJoin(F.broadcast(names))  # a row
    else:
        numbers = [r[0] for r in names.select("__block").distinct().collect()]  # a row a block
        wide = known.withColumn("__block", F.explode(F.array(*map(F.lit, numbers)) if numbers else F.array().cast("array<int>"))).join(names, "__block")
    return wide.select(key, "label", F.inline("names")).select(key, "class_idx", (F.col("class") == F.col("label")).cast("int").alias("y"))


def label_index(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows whose label is a class, with class_idx."""
    return labels.join(classes, labels["label"] == classes["class"]).drop("class")


def species_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Names of a list: trimmed, without blanks, once each, sorted."""
    name = F.trim(F.col(column))
    return lines.select(name.alias("species")).where(F.length("species") > 0).distinct().orderBy("species")


def combined_species(lists: DataFrame, most: int | None = None) -> DataFrame:
    """species from rows (list, place, species): lists take turns with their first mentions; the first `most` names, sorted."""
    firsts = lists.groupBy("list", "species").agg(F.min("place").alias("place"))
    turn = F.row_number().over(Window.partitionBy("list").orderBy("place"))
    names = firsts.withColumn("turn", turn).groupBy("species").agg(F.min(F.struct("turn", "list")).alias("at")).orderBy("at")
    return (names.limit(most) if most is not None else names).select("species").orderBy("species")


def layered(*values: Column) -> Column:
    """The first value that is not null or empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


# Names by which frontends also go.
ALIASES = {"precomputed": "librosa", "tf": "raw"}
FRONTENDS = ["librosa", "hybrid", "raw", "mfcc", "log_mel"]


def frontend(name: Column) -> Column:
    """The frontend a name stands for; an unknown name is an error."""
    low = F.lower(name)
    known = reduce(lambda c, x: c.when(low == x[0], F.lit(x[1])), list(ALIASES.items())[1:], F.when(low == list(ALIASES)[0], F.lit(ALIASES[list(ALIASES)[0]])))
    return known.when(low.isin(FRONTENDS), low).otherwise(F.raise_error(F.concat(F.lit("unknown frontend: "), name)).cast("string"))
