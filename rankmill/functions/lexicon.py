"""Words of the French plumbing and building trade that the query normalizer knows. All are fixed values, folded."""

COLORS = {
    "blanc": "blanc", "blanche": "blanc", "blancs": "blanc", "gris": "gris", "grise": "gris", "anthracite": "anthracite", "bleu": "bleu", "rouge": "rouge",
    "noir": "noir", "noire": "noir", "vert": "vert", "verte": "vert", "jaune": "jaune", "orange": "orange", "beige": "beige", "brun": "brun",
    "marron": "marron", "transparent": "transparent", "argent": "argent", "chrome": "chromé",
}
MATERIALS = {
    "pvc": "PVC", "pe": "PE", "pehd": "PEHD", "pp": "PP", "ppr": "PPR", "per": "PER", "cuivre": "cuivre", "cu": "cuivre", "laiton": "laiton", "inox": "inox",
    "acier": "acier", "fonte": "fonte", "plastique": "plastique", "beton": "béton", "caoutchouc": "caoutchouc", "polyethylene": "polyéthylène",
}
ABBREVIATIONS = {
    "dia": "diamètre", "diam": "diamètre", "dn": "diamètre", "lg": "longueur", "long": "longueur", "larg": "largeur", "evac": "évacuation",
    "assain": "assainissement",
}
SYNONYMS = [["evacuation", "assainissement"], ["tuyau", "tube"]]
#: Words that make a number after them a dimension.
KEYWORDS = {"diametre": "diameter", "longueur": "length", "largeur": "width"}
#: Millimetres in a unit of length.
UNITS = {"mm": 1, "cm": 10, "dm": 100, "m": 1000}
#: Attributes a model's answer may name.
ATTRIBUTES = ["diameter", "length", "width", "color", "material", "section", "height", "weight", "pressure", "power", "thread"]
#: Right spellings beside colours, materials, synonyms and the catalogue's own words.
WORDS = [
    "tube", "tuyau", "raccord", "coude", "manchon", "vanne", "robinet", "cable", "gaine", "colle", "joint", "bague", "ecrou", "reduction", "bouchon",
    "goulotte", "evacuation", "assainissement", "blanc", "gris", "noir", "bleu", "rouge", "vert", "jaune", "flexible", "rigide", "diametre", "longueur",
    "largeur", "chantier",
]
