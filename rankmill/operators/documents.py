"""Search documents: labelled attributes, the searchable text, its hash, and the five indexed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUILDER_VERSION = "1.0.0"
#: Indexed fields, in the order of their numbers.
FIELDS = ("code", "name", "attributes", "brand", "category")
#: Display labels of attribute keys. Fixed values.
LABELS = {
    "diameter": "diamètre", "diameter_mm": "diamètre", "diameter_cm": "diamètre", "length": "longueur", "width": "largeur", "height": "hauteur",
    "depth": "profondeur", "thickness": "épaisseur", "weight": "poids", "color": "couleur", "colour": "couleur", "material": "matière",
    "brand": "marque", "model": "modèle", "power": "puissance", "voltage": "tension", "current": "intensité", "frequency": "fréquence",
    "pressure": "pression", "temperature": "température", "capacity": "capacité", "volume": "volume", "thread": "filetage", "finish": "finition",
    "density": "densité", "flow_rate": "débit", "size": "taille", "pack_quantity": "quantité par paquet", "norm": "norme", "usage": "usage",
    "type": "type", "gender": "genre", "thread_size": "dimension filetage", "length_m": "longueur", "rating": "classe",
}


def humanize(key: Column) -> Column:
    words = F.trim(F.regexp_replace(key, "[_-]+", " "))
    return F.when(words == "", key).otherwise(words)


def label(key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.element_at(known, key), humanize(key))


def pairs(attributes: Column) -> Column:
    """(key, value) of the attributes that aren't blank, by key, values trimmed."""
    kept = F.map_filter(F.coalesce(attributes, F.create_map().cast("map<string,string>")), lambda k, v: F.trim(v) != "")
    return F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.struct(e["key"].alias("key"), F.trim(e["value"]).alias("value")))


def build(products: DataFrame, version: str = BUILDER_VERSION) -> DataFrame:
    """Products -> adds search_document, builder_version, document_hash and fields (array of five texts)."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit(""))
    p = products.where(F.coalesce("product_id", F.lit("")) != "").withColumn("__pairs", pairs(F.col("attributes")))
    shown = F.transform("__pairs", lambda e: F.concat(label(e["key"]), F.lit(" "), e["value"]))
    texts = F.concat(F.array(filled("code"), filled("name")), shown, F.array(filled("brand"), filled("category"), filled("subcategory")))
    document = F.array_join(F.filter(texts, lambda t: t != ""), " | ")
    listed = F.transform("__pairs", lambda e: F.array(e["key"], e["value"]))
    hashed = F.to_json(F.struct(
        F.lit(version).alias("v"), F.col("product_id").alias("id"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("name", F.lit("")).alias("name"),
        listed.alias("attributes"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("brand", "category", "subcategory")],
    ))
    category = F.concat_ws(" ", F.nullif(filled("category"), F.lit("")), F.nullif(filled("subcategory"), F.lit("")))
    fields = F.array(filled("code"), filled("name"), F.array_join(shown, " "), filled("brand"), category)
    out = p.withColumns({"search_document": document, "builder_version": F.lit(version), "document_hash": F.sha2(hashed, 256), "fields": fields})
    return out.drop("__pairs")
