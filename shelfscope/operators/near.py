"""Near hashes by multi-index hashing, and the greedy choice of images in rounds."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import drop_table, materialize


def near_hashes(rows: DataFrame, *, apart: int, bits: int = 64, radius: int = 1) -> DataFrame:
    """(within, a, b, distance): pairs a < b of one `within` whose hashes differ in at most `apart` of their low `bits` bits.

    rows: within, id, hash (long); rows without a hash or a `within` are in no pair. The hash is cut into so many parts that one of
    them must differ in at most `radius` bits; each row is found under its own parts and asks for all parts within the radius, so only
    such rows meet. A pair is kept where its first such part met, so no pair comes twice. Equal hashes still meet pair by pair:
    collapse them first where that matters. A `within` of no more rows than a row would ask for keys is one row and pairs its hashes itself.
    """
    parts = apart // (radius + 1) + 1
    if parts * max(1, radius) > bits:
        raise ValueError("too many parts for so few bits: take another radius")
    edges = [i * bits // parts for i in range(parts + 1)]
    whole = F.col("hash") if bits == 64 else F.col("hash").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    cut = lambda h, i: F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("long"))
    flips = [[sum(1 << p for p in at) for n in range(radius + 1) for at in combinations(range(edges[i + 1] - edges[i]), n)] for i in range(parts)]
    all_ = rows.where(F.col("hash").isNotNull() & F.col("within").isNotNull()).select("within", "id", whole.alias("hash"))
    many = all_.groupBy("within").agg(F.count("*").alias("n")).where(F.col("n") > sum(map(len, flips))).select("within")
    known = all_.join(many, "within", "left_semi")
    listed = all_.join(many, "within", "left_anti").groupBy("within").agg(F.collect_list(F.struct("id", "hash")).alias("x")).where(F.size("x") > 1)
    apart_ = lambda a, b: F.bit_count(a["hash"].bitwiseXOR(b["hash"]))
    near = lambda a: F.filter("x", lambda b: (a["id"] < b["id"]) & (apart_(a, b) <= apart))
    few = F.flatten(F.transform("x", lambda a: F.transform(near(a), lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b"), apart_(a, b).alias("distance")))))
    few = listed.select("within", F.inline(few))
    own = F.array(*(F.struct(F.lit(i).alias("part"), cut(F.col("hash"), i).alias("key")) for i in range(parts)))

    def around(i: int) -> Column:
        flipped = F.array(*(F.lit(x).cast("long") for x in flips[i]))
        return F.transform(flipped, lambda x: F.struct(F.lit(i).alias("part"), cut(F.col("hash"), i).bitwiseXOR(x).alias("key")))

    asked = F.flatten(F.array(*map(around, range(parts))))
    index = known.select("within", F.col("id").alias("b"), F.col("hash").alias("there"), F.explode(own).alias("k")).select("within", "b", "there", "k.*")
    probes = known.select("within", F.col("id").alias("a"), F.col("hash").alias("here"), F.explode(asked).alias("k")).select("within", "a", "here", "k.*")
    differ: Column = F.col("here").bitwiseXOR(F.col("there"))
    first = reduce(lambda rest, i: F.when(F.bit_count(cut(differ, i)) <= radius, i).otherwise(rest), reversed(range(parts)), F.lit(None).cast("int"))
    met = probes.join(index, ["within", "part", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= apart) & (first == F.col("part")))
    return met.select("within", "a", "b", F.bit_count(differ).alias("distance")).unionByName(few)


def greedy_images(images: DataFrame, most: int = 12, apart: int = 5) -> DataFrame:
    """Of each product's images (product_id, image_id, width, height, hash) the largest first, without those that look like one taken.

    Of equal hashes only the largest image can be taken. The others are decided in rounds, for all products at once: an image that no
    undecided or taken larger one looks like is taken, one that looks like a taken larger one goes. The rounds are as many as the
    longest chain of ever smaller images that look alike. Images without a hash look like no other. Rows that repeat an id are images
    of their own. Ties go to the smaller image_id, then to the larger hash. Of images without a product only equal hashes are told.
    """
    size = F.struct((F.col("width") * F.col("height")).alias("area"), (-F.col("image_id")).alias("i"))
    rows = images.withColumn("__size", size)
    same = Window.partitionBy("product_id", "hash").orderBy(F.col("__size").desc())
    hashed = rows.where(F.col("hash").isNotNull()).withColumn("__nth", F.row_number().over(same)).where("__nth = 1").drop("__nth")
    alone = materialize(hashed, "images-distinct")
    pairs = near_hashes(alone.select(F.col("product_id").alias("within"), F.col("hash").alias("id"), "hash"), apart=apart)
    sized = alone.select(F.col("product_id").alias("within"), "hash", "__size")
    with_sizes = pairs.join(sized.select("within", F.col("hash").alias("a"), F.col("__size").alias("sa")), ["within", "a"]).join(sized.select("within", F.col("hash").alias("b"), F.col("__size").alias("sb")), ["within", "b"])
    larger = F.col("sa") > F.col("sb")  # of equal sizes the larger hash, b, is the larger image
    links = materialize(with_sizes.select("within", F.when(larger, F.col("a")).otherwise(F.col("b")).alias("big"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("small")), "images-links")
    gone, open_ = None, links
    while not open_.isEmpty():
        # An image that stands only on the larger side of links is taken; what looks like it goes, with all its links.
        smalls = open_.select("within", F.col("small").alias("big")).distinct()
        taken = open_.select("within", "big").distinct().join(smalls, ["within", "big"], "left_anti")
        now = materialize(open_.join(taken, ["within", "big"]).select("within", "small").distinct(), "images-gone")
        left = open_.join(now, ["within", "small"], "left_anti").join(now.select("within", F.col("small").alias("big")), ["within", "big"], "left_anti")
        after = materialize(left.select("within", "big", "small"), "images-open")
        drop_table(open_)
        gone, open_ = now if gone is None else gone.unionByName(now), after
    kept = alone if gone is None else alone.join(gone.select(F.col("within").alias("product_id"), F.col("small").alias("hash")), ["product_id", "hash"], "left_anti")
    all_ = kept.unionByName(rows.where(F.col("hash").isNull()))
    nth = F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("__size").desc()))
    return all_.withColumn("__nth", nth).where(F.col("__nth") <= most).select(*images.columns)
