"""What a marker looks like outside: counts in words, GeoJSON, and the tags of a tile's features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import unproject_x, unproject_y


def count_abbreviation(n: Column) -> Column:
    """7, 999, 1k, 1.2k, 10k: one decimal below ten thousand, a trailing .0 dropped."""
    tenths = F.round(n / 100.0).cast("bigint")
    whole, rest = F.floor(tenths / 10).cast("string"), tenths % 10
    small = F.when(rest == 0, F.concat(whole, F.lit("k"))).otherwise(F.concat(whole, F.lit("."), rest.cast("string"), F.lit("k")))
    return F.when(n >= 10_000, F.concat(F.round(n / 1000.0).cast("bigint").cast("string"), F.lit("k"))).when(n >= 1_000, small).otherwise(n.cast("string"))


def placed(markers: DataFrame) -> DataFrame:
    """markers(cnt, sx, sy, ...) with lng and lat of the mean position, taken in the plane of the map."""
    return markers.withColumn("lng", unproject_x(F.col("sx") / F.col("cnt"))).withColumn("lat", unproject_y(F.col("sy") / F.col("cnt")))


def geojson(features: DataFrame) -> DataFrame:
    """(rep, feature): a GeoJSON Feature for each row of (rep, is_cluster, device, cluster_id, count, lng, lat, props)."""
    cluster = F.to_json(
        F.struct(
            F.lit(True).alias("cluster"),
            F.col("cluster_id"),
            F.col("count").alias("point_count"),
            count_abbreviation(F.col("count")).alias("point_count_abbreviated"),
        )
    )
    own = F.coalesce(F.col("props"), F.to_json(F.struct(F.col("device").alias("id"))))
    place = F.concat(F.lit("["), F.col("lng").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    text = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":'),
        place,
        F.lit('},"properties":'),
        F.when(F.col("is_cluster"), cluster).otherwise(own),
        F.lit("}"),
    )
    return features.select("rep", text.alias("feature"))


def feature_collection(features: DataFrame) -> DataFrame:
    """One row with all features of a (bounded) viewport."""
    rows = geojson(features).agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("f"))
    return rows.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("f"), F.lit("]}")).alias("geojson"))


def scalar_tags(df: DataFrame, props: str = "props") -> DataFrame:
    """df's rows with each top-level scalar of a JSON object: (…, key, kind, value).

    Strings, booleans and unsigned integers keep their type, other numbers become strings; nulls, arrays and objects are left
    out, as are the keys cluster and id, which belong to the engine. A value's type is that of the value itself."""
    parsed = df.withColumn("_parsed", F.try_parse_json(props))
    member = parsed.sparkSession.tvf.variant_explode(F.col("_parsed").outer()).alias("m")
    typed = parsed.lateralJoin(member).select("*").drop("pos", "_parsed")
    of, text = F.schema_of_variant("value"), F.col("value").cast("string")
    whole = of.isin("BIGINT") | F.regexp_like(of, F.lit(r"^DECIMAL\([0-9]+,0\)$"))
    # 64 bits unsigned: no more digits than the largest such number, and not above it as text of the same length
    fits = F.regexp_like(text, F.lit("^[0-9]+$")) & ((F.length(text) < 20) | ((F.length(text) == 20) & (text <= "18446744073709551615")))
    number = whole | (of == "DOUBLE") | of.startswith("DECIMAL") | (of == "FLOAT")
    kind = F.when(of == "STRING", "string").when(of == "BOOLEAN", "bool").when(whole & fits, "uint").when(number, "string")
    out = typed.withColumn("kind", kind).withColumn("value", text)
    return out.where(F.col("kind").isNotNull() & ~F.col("key").isin("cluster", "id"))
