"""A synthetic French trade catalog and its rule-made relevance labels, computed row by row in Catalyst.

The catalog is drawn from a counter-based generator: its n-th number depends on the seed and n only. Rows of one family take equally
many numbers, so the place of a row's first number follows from its index, and rows can be made anywhere in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Category, subcategory, names, colours, diameters in mm, lengths in m, sections, powers, materials, letters of the code.
FAMILIES = [
    ("Plomberie", "Évacuation", ["Tube PVC évacuation", "Tube PVC assainissement", "Tube PVC drainage"], ["blanc", "gris", "orange"],
     [32, 40, 50, 63, 80, 100, 110, 125, 160, 200], [2, 4, 6], [], [], ["PVC"], "T"),
    ("Plomberie", "Pression", ["Tube PPR pression", "Tube PER", "Tube PEHD assainissement"], ["blanc", "gris", "bleu", "noir"],
     [16, 20, 25, 32, 40, 50, 63], [2, 4, 6], [], [], ["PPR", "PER", "PEHD"], "TP"),
    ("Plomberie", "Raccords", ["Coude PVC 90°", "Manchon PVC", "Té PVC", "Réduction PVC", "Raccord à bague PVC"], ["blanc", "gris"],
     [32, 40, 50, 63, 80, 100, 110, 125], [], [], [], ["PVC", "PPR"], "R"),
    ("Plomberie", "Robinetterie", ["Vanne à boisseau PVC", "Robinet à flotteur", "Vanne d'arrêt laiton", "Vanne à papillon PVC"], ["bleu", "gris", "chromé"],
     [20, 25, 32, 40, 50, 63, 110], [], [], [], ["PVC", "laiton"], "V"),
    ("Électricité", "Câbles", ["Câble rigide H07V-U", "Câble souple H05V-F", "Câble rigide 3G", "Câble souple 5G"],
     ["bleu", "rouge", "vert", "jaune", "noir", "gris"], [], [25, 50, 100], ["1.5 mm²", "2.5 mm²", "4 mm²", "6 mm²"], [], ["cuivre"], "C"),
    ("Électricité", "Gaines", ["Gaine ICTA", "Goulotte PVC", "Gaine TPC", "Chemins de câbles"], ["noir", "gris", "blanc"],
     [16, 20, 25, 32, 40], [25, 50, 100], [], [], ["PVC", "PE"], "G"),
    ("Matériaux", "Étanchéité", ["Joint caoutchouc", "Joint plat fibre", "Colle PVC", "Mastic sanitaire", "Ruban étanche"], ["noir", "blanc", "gris"],
     [], [], [], [], ["caoutchouc", "PVC", "silicone"], "J"),
    ("Outillage", "Soudure", ["Poste à souder", "Chalumeau gaz", "Buse de rechange", "Poste à souder MIG"], ["bleu", "noir", "rouge"],
     [], [], [], ["120 W", "400 W", "1.5 kW", "3 kW"], [], "S"),
]
BRANDS = ["Somaterial", "PlumboPro", "ElecMax", "TechnoFix", "BatiPlus", "AquaLine"]

#: Query, its rules as (word of the name, diameter, colour, further attribute, its value, label); None asks for nothing.
GOLD = {
    "tube 110 blanc": [("Tube", "110 mm", "blanc", None, None, 4), ("Tube", "110 mm", None, None, None, 2)],
    "tube 110 blnc": [("Tube", "110 mm", "blanc", None, None, 4), ("Tube", "110 mm", None, None, None, 2)],
    "tube évacuation 110": [("évacuation", "110 mm", None, None, None, 4), ("évacuation", None, None, None, None, 2)],
    "tube assainissement 160": [("assainissement", "160 mm", None, None, None, 4), ("évacuation", "160 mm", None, None, None, 2)],
    "Ø110": [("Tube", "110 mm", None, None, None, 3), (None, "110 mm", None, None, None, 2)],
    "DN110": [("Tube", "110 mm", None, None, None, 3), (None, "110 mm", None, None, None, 2)],
    "tube 110mm": [("Tube", "110 mm", None, None, None, 4)],
    "raccord à bague 110 blanc": [("bague", "110 mm", None, None, None, 4)],
    "coude 125": [("Coude", "125 mm", None, None, None, 4)],
    "té pvc 63": [("Té", "63 mm", None, None, None, 4)],
    "câble rigide 2.5": [("rigide", None, None, "section", "2.5 mm²", 4), ("rigide", None, None, None, None, 2)],
    "cable souple 1.5 noir": [("souple", None, "noir", "section", "1.5 mm²", 4), ("souple", None, None, "section", "1.5 mm²", 2)],
    "gaine icta 32": [("ICTA", "32 mm", None, None, None, 4)],
    "gaine icta 40 gris": [("ICTA", "40 mm", "gris", None, None, 4), ("ICTA", "40 mm", None, None, None, 2)],
    "vanne d'arrêt laiton 50": [("arrêt", "50 mm", None, None, None, 4), ("Vanne", "50 mm", None, None, None, 2)],
    "vanne papillon 110": [("papillon", "110 mm", None, None, None, 4)],
    "tube ppr 32": [(None, "32 mm", None, "material", "PPR", 4), ("Tube", "32 mm", None, None, None, 2)],
    "tube pehd 25 bleu": [("PEHD", "25 mm", "bleu", None, None, 4), ("PEHD", "25 mm", None, None, None, 2)],
    "tube drainage 50": [("drainage", "50 mm", None, None, None, 4)],
    "tube 160 gris": [("Tube", "160 mm", "gris", None, None, 4), ("Tube", "160 mm", None, None, None, 2)],
    "chemin de câbles 20": [("Chemins", "20 mm", None, None, None, 4), ("Chemins", None, None, None, None, 2)],
    "tube evacuation 4m": [("évacuation", None, None, "length", "4 m", 4), ("évacuation", None, None, None, None, 1)],
    "tube 63 6m orange": [("Tube", "63 mm", "orange", "length", "6 m", 4), ("Tube", "63 mm", "orange", None, None, 2)],
    "manchon pvc 80": [("Manchon", "80 mm", None, None, None, 4)],
    "réduction 125": [("Réduction", "125 mm", None, None, None, 4)],
    "câble 6mm": [("Câble", None, None, "section", "6 mm²", 4), ("Câble", None, None, None, None, 1)],
    "gaine noire 20": [("Gaine", "20 mm", "noir", None, None, 4), ("Gaine", "20 mm", None, None, None, 2)],
    "robinet flotteur": [("flotteur", None, None, None, None, 4)],
}

_WORD = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without leaving 64 bits."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_WORD))


def draw(seed: int, n: Column) -> Column:
    """The n-th number, from 1, of the Mulberry32 generator: a double from 0 up to 1."""
    state = (_times(n.cast("long"), F.lit(0x6D2B79F5).cast("long")) + F.lit(seed & _WORD)).bitwiseAND(F.lit(_WORD))
    t = _times(state.bitwiseXOR(F.shiftrightunsigned(state, 15)), state.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_WORD)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def catalog(spark: SparkSession, size: int, seed: int = 42, prefix: str = "P") -> DataFrame:
    """size products of eight families in turn, in the columns of a product source."""
    takes = [3 + sum(bool(values) for values in family[4:9]) for family in FAMILIES]
    first = F.get(F.array(*[F.lit(sum(takes[:k])) for k in range(len(takes))]), F.col("family"))
    rows = spark.range(size).withColumn("family", (F.col("id") % len(FAMILIES)).cast("int"))
    rows = rows.withColumn("at", F.floor(F.col("id") / len(FAMILIES)) * sum(takes) + first)

    # Drawn once a row, as one array: written out at each use they made a stage too long to compile.
    rows = rows.withColumn("draws", F.transform(F.sequence(F.lit(1), F.lit(max(takes))), lambda nth: draw(seed, F.col("at") + nth)))

    def pick(values: Column, nth: Column) -> Column:
        return F.get(values, F.floor(F.get("draws", nth - 1) * F.size(values)).cast("int"))

    def of(make) -> Column:
        """One value a family."""
        out = F.when(F.col("family") == 0, make(FAMILIES[0]))
        for k, family in enumerate(FAMILIES[1:], 1):
            out = out.when(F.col("family") == k, make(family))
        return out

    listed = lambda values, unit="": F.array(*[F.lit(f"{v}{unit}") for v in values])
    rows = rows.withColumns({"name": of(lambda f: pick(listed(f[2]), F.lit(1))), "color": of(lambda f: pick(listed(f[3]), F.lit(2))), "brand": pick(listed(BRANDS), F.lit(3))})
    for k, (name, unit) in enumerate([("diameter", " mm"), ("length", " m"), ("section", ""), ("power", ""), ("material", "")], 4):
        place = lambda f, k=k: F.lit(4 + sum(bool(values) for values in f[4:k]))
        rows = rows.withColumn(name, of(lambda f, k=k, unit=unit, place=place: pick(listed(f[k], unit), place(f)) if f[k] else F.lit(None).cast("string")))
    part = lambda letter, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(letter), F.regexp_replace(c, "[^0-9.]", ""))).otherwise("")
    code = F.concat(of(lambda f: F.lit(f[9])), part("D", "diameter"), part("L", "length"), part("S", "section"), part("W", "power"), F.upper(F.substring("color", 1, 2)), F.col("id").cast("string"))
    names = ["color", "diameter", "length", "section", "power", "material"]
    attributes = F.map_from_entries(F.filter(F.array(*[F.when(F.col(a).isNotNull(), F.struct(F.lit(a).alias("key"), F.col(a).alias("value"))) for a in names]), lambda e: e.isNotNull()))
    return rows.select(
        F.concat(F.lit(prefix), F.lpad((F.col("id") + 1).cast("string"), 6, "0")).alias("product_id"), code.alias("code"), "name", attributes.alias("attributes"), "brand",
        of(lambda f: F.lit(f[0])).alias("category"), of(lambda f: F.lit(f[1])).alias("subcategory"),
    )


def fixture(spark: SparkSession) -> DataFrame:
    return catalog(spark, 200, 7)


def gold(products: DataFrame) -> DataFrame:
    """(query, product_id, label): the largest label of the rules that a product meets. 100 mm PVC fittings and one code are asked for too."""

    def meets(word, diameter, color, name, value) -> Column:
        a = F.col("attributes")
        asked = [F.contains("name", F.lit(word)) if word else None, a["diameter"] == diameter if diameter else None, a["color"] == color if color else None, a[name] == value if name else None]
        out = F.lit(True)
        for condition in asked:
            out = out if condition is None else out & F.coalesce(condition, F.lit(False))
        return out

    made = [F.struct(F.lit(q).alias("query"), F.greatest(*[F.when(meets(*rule[:5]), rule[5]).otherwise(0) for rule in rules], F.lit(0)).alias("label")) for q, rules in GOLD.items()]
    fitting = ~F.col("name").rlike("Tube|Vanne|Câble|Gaine") & meets(None, "100 mm", None, "material", "PVC")
    made.append(F.struct(F.lit("raccord pvc 100").alias("query"), F.when(fitting, 4).otherwise(0).alias("label")))
    made.append(F.struct(F.lit("TD110L4BL0").alias("query"), F.when(F.col("code") == "TD110L4BL0", 4).otherwise(0).alias("label")))
    found = products.select("product_id", F.explode(F.array(*made)).alias("g")).where("g.label > 0")
    return found.select(F.col("g.query").alias("query"), "product_id", F.col("g.label").cast("double").alias("label"))
