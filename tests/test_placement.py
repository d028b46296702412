from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.operators.placement import place


def test_rounds_place_what_the_sequential_rule_places(spark):
    k = F.col("id")
    x, y, w = ((k * 7919) % 60).cast("double"), ((k * 104729) % 50).cast("double"), (1 + k % 9).cast("double")
    square = G.polygon(F.array(G.xy(x, y), G.xy(x + w, y), G.xy(x + w, y + w), G.xy(x, y + w)))
    rows = spark.range(240).select((k % 3).alias("scene_id"), "id", F.when(k != 7, square).alias("geom"), ((k * 31) % 17).alias("rank"), F.lit("x").alias("better"))
    got = {(r.scene_id, r.id) for r in place(rows, ["rank"]).collect()}
    want, held = set(), {0: [], 1: [], 2: []}
    for r in sorted(rows.where("geom IS NOT NULL").collect(), key=lambda r: (r.rank, r.id)):
        g = r.geom
        if all(g.minx > o.maxx or o.minx > g.maxx or g.miny > o.maxy or o.miny > g.maxy for o in held[r.scene_id]):
            held[r.scene_id].append(g)
            want.add((r.scene_id, r.id))
    assert got == want and 20 < len(want) < 200
    assert place(rows.limit(0), ["rank"]).count() == 0
