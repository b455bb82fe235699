"""Category and family of a product from drifting hierarchy columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions.text import clean_text, strip_accents
from stocktide.session import cut_lineage

UNKNOWN = "NECUNOSCUT"
# Text that names a sales channel, not a product group.
CHANNEL_VALUES = ("ONLINE", "OUTLET", "VANZARI DIRECTE", "VANZARI DIRECTE OFFICE", "SALARIATI")
# Text that means nothing.
JUNK_VALUES = ("", "#NULL", "-", ".", "NULL", "NAN", "NONE")
# Category -> the names that stand for it.
EXACT_CATEGORIES = {
    "ACCESORII": (
        "ACCESORII", "ACCESORI", "MOBILIER DE CASA - ACCESORII", "DECORATIUNI", "DECORATIUNI OUTDOOR",
        "DECO & ACCESORII", "MOBILIER INTERIOR - DECO & ACCESORII", "CORPURI DE ILUMINAT", "COVOR", "TABLETOP",
        "GOURMET", "GREEN PLANTE", "GREEN VAZE", "CHRISTMAS", "TAPET", "TEXTILE BAIE", "TEXTILE MASA", "TEXTILE PAT",
        "DECO FEREASTRA", "DECO PERETE", "ALTE DECO", "ODORIZANTE", "ACCESORII BAIE", "CUIER",
        "GRATARE SI ACCESORII"),
    "MOBILIER DE CASA": (
        "MOBILIER DE CASA", "MOBILIER CASA", "MOBILIER GENERAL", "MOBILIER", "MOBILI", "MIC MOBILIER",
        "MOBILIER DE CASA - MIC MOBILIER", "MOBILIERA DE CASA-MIC MOBILIER", "MOBILIER CORP", "TOTAL MOBILIER CASA",
        "CAMERE COPII", "CAMERE TINERET/ COPII", "MOBILIER SCOLI SI GRADINITE", "MESE SI SCAUNE", "DEPOZITARE",
        "LIVING", "CASUTA", "CASA FIXA", "CASA MOBILA", "CASUTA MOBILA"),
    "CANAPELE SI FOTOLII": (
        "CANAPELE SI FOTOLII", "CANAPELE SI FOTOLII CU RECLINER", "CANAPEE SI FOTOLII", "SOFTMEX"),
    "SALTELE SI SOMIERE": ("SALTELE SI SOMIERE", "SERTA", "SEALY", "GENETICS", "CULTURA SOMNULUI"),
    "PATURI TAPITATE": ("PATURI TAPITATE",),
    "MOBILIER BAIE SI SANITARE": (
        "MOBILIER BAIE SI SANITARE", "MOBILIER BAIE SI SANITRE", "MOBILIER BAIE SI SANIATRE",
        "MOBILIER DE BAIE SI SANITARE", "MOBILIER BAIE SANITARE", "MOBILIER DE BAIE", "MOBILIER BAIE", "SANITARE",
        "SANITARE BAIE"),
    "MOBILIER OFFICE": (
        "MOBILIER OFFICE", "MOBILER OFFICE", "MOBILIER BIROU", "OFFICE", "TOTAL OFFICE", "SCAUNE BIROU OPERATIONALE",
        "SCAUNE BIROU MANAGERIALE", "SCAUN OPERATIONAL", "SCAUNE VIZITATOR", "BIROURI MANAGERIALE",
        "BIROURI OPERATIONALE", "SALI CONSILIU", "ZONA ASTEPTARE"),
    "MOBILIER BUCATARII": (
        "MOBILIER DE CASA - BUCATARII", "MOBILIER DE CASA-BUCATARII", "MOBILIER DE CASA -BUCATARII", "BUCATARII",
        "APARATURA", "ELECTROCASNICE", "BLATURI COMPOZIT"),
    "MOBILIER TERASA SI GRADINA": (
        "MOBILIER TERASA SI GRADINA, INDOOR, ACCESORII", "MOBILIER TERASA SI GRADINA", "MOBILIER TERASA SI GARADINA",
        "MOBILIER TERASA SI GARDINA", "MOBILIER GRADINA - OUTDOOR", "MOBILIER OUTDOOR", "OUTDOOR"),
    "ALTELE": ("AMBALAJE", "SEMIFABRICATE", "PROTOTIPURI", "COMENZI SPECIALE", "LICITATII", "BF 2022 PROMOTII"),
}
# Words looked for in this order when no exact name fits.
CATEGORY_WORDS = (
    ("PATURI TAPITATE", ("PATURI TAPITATE", "PAT TAPITAT")),
    ("MOBILIER OFFICE", (
        "MOBILIER OFFICE", "MOBILER OFFICE", "OFFICE", "BIROU", "BIROURI", "SCAUNE BIROU", "OPERATIONAL", "MANAGERIAL",
        "VIZITATOR", "SALI CONSILIU", "ZONA ASTEPTARE", "GESTIUNEA CABLURILOR")),
    ("MOBILIER BUCATARII", ("BUCATAR", "APARATURA", "ELECTROCASNICE", "BLATURI COMPOZIT")),
    ("MOBILIER BAIE SI SANITARE", ("BAIE", "SANITARE")),
    ("MOBILIER TERASA SI GRADINA", ("TERASA", "GRADINA", "OUTDOOR", "RATAN")),
    ("SALTELE SI SOMIERE", (
        "SALTEA", "SALTELE", "SOMIER", "SERTA", "SEALY", "GENETICS", "CULTURA SOMNULUI", "PATSPRING")),
    ("CANAPELE SI FOTOLII", ("CANAPE", "FOTOLI", "RECLINER", "SOFTMEX", "COLTAR")),
    ("ACCESORII", (
        "DECORATIUNI", "DECOR", "DECO", "ACCESORII", "CORPURI DE ILUMINAT", "ILUMINAT", "COVOR", "COVOARE", "TEXTILE",
        "TABLETOP", "GOURMET", "GREEN", "CHRISTMAS", "TAPET", "ODORIZANTE", "PERDELE", "DRAPERII", "VAZE")),
    ("MOBILIER DE CASA", (
        "MOBILIER CASA", "MOBILIER DE CASA", "MOBILIER CORP", "CAMERE COPII", "TINERET", "COPII", "DORMITOARE",
        "SUFRAGERII", "BIBLIOTECI", "MIC MOBILIER", "MESE SI SCAUNE", "DEPOZITARE", "LIVING", "HOLURI", "DRESSING",
        "HORECA", "CASUTA", "SCOLI SI GRADINITE")),
    ("ALTELE", ("AMBALAJE", "SEMIFABRICATE", "PROTOTIPURI", "COMENZI SPECIALE", "LICITATII")),
)
# Family names written in more than one way.
FAMILY_NAMES = {
    "CANAPEE SI FOTOLII": "CANAPELE SI FOTOLII",
    "MOBILIER GRADINA - OUTDOOR": "MOBILIER OUTDOOR",
    "MOBILIER DE CASA - BUCATARII": "BUCATARII",
    "MOBILIER DE CASA-BUCATARII": "BUCATARII",
    "MOBILIER DE CASA -BUCATARII": "BUCATARII",
    "MOBILIER DE CASA - ACCESORII": "ACCESORII",
    "MOBILIER INTERIOR - DECO & ACCESORII": "DECO & ACCESORII",
    "MOBILIER BAIE SI SANITRE": "MOBILIER BAIE SI SANITARE",
    "SANITARE BAIE": "SANITARE",
}
RAW_COLUMNS = ("category_raw", "class_raw", "subclass_raw", "group_raw", "raion_raw", "product_name")
RESULT_COLUMNS = (
    "category_norm", "category_source", "category_signal_status",
    "product_family_v2", "product_family_source", "product_family_signal_status",
)


def _key(c: Column) -> Column:
    return strip_accents(clean_text(c))


def _bare(key: Column) -> Column:
    """Key without the leading numeric code and the word TOTAL."""
    return F.regexp_replace(F.regexp_replace(key, r"^\d{1,4}\s+", ""), r"^TOTAL\s+", "")


def map_category(key: Column, bare: Column) -> Column:
    out = F.when(key.isin(*JUNK_VALUES), F.lit(None).cast("string"))
    for category, names in EXACT_CATEGORIES.items():
        out = out.when(bare.isin(*names), category)
    for category, words in CATEGORY_WORDS:
        out = out.when(bare.rlike("|".join(words)), category)
    return out


def map_family(key: Column, bare: Column) -> Column:
    bad = key.isin(*JUNK_VALUES) | bare.isin(*JUNK_VALUES) | bare.isin(*CHANNEL_VALUES)
    out = F.when(bad, F.lit(None).cast("string"))
    for name, target in FAMILY_NAMES.items():
        out = out.when(bare == name, target)
    return out.otherwise(bare)


FIELDS = RAW_COLUMNS[:5]
FAMILY_ORDER = ("group_raw", "subclass_raw", "class_raw", "category_raw", "raion_raw")


def hierarchy_table(raw: DataFrame) -> DataFrame:
    """Category and family of every distinct raw hierarchy tuple.

    The names are unfolded to one row per field, so each rule stands once in
    the plan; the first field with a result wins.
    """
    t = raw.select(*FIELDS).distinct()
    long = t.select("*", F.inline(F.array(*[
        F.struct(F.lit(f).alias("_f"), F.lit(i).alias("_c"), F.lit(FAMILY_ORDER.index(f)).alias("_p"), _key(F.col(f)).alias("_key"))
        for i, f in enumerate(FIELDS)])))
    channel = (F.col("_f") == "raion_raw") & F.col("_key").isin(*CHANNEL_VALUES)
    long = long.where(~channel).withColumn("_bare", _bare(F.col("_key")))
    long = long.withColumns({"_cat": map_category(F.col("_key"), F.col("_bare")), "_fam": map_family(F.col("_key"), F.col("_bare"))})
    first = lambda v, order: F.min(F.when(F.col(v).isNotNull(), F.struct(F.col(order).alias("o"), F.col(v).alias("v"), F.col("_f").alias("s"))))
    g = long.groupBy(*FIELDS).agg(first("_cat", "_c").alias("c"), first("_fam", "_p").alias("f"))
    return g.select(*FIELDS, F.col("c.v").alias("_cat"), F.col("c.s").alias("_cat_src"), F.col("f.v").alias("_fam"), F.col("f.s").alias("_fam_src"))


def hierarchy_columns(df: DataFrame) -> DataFrame:
    """Add the six hierarchy result columns.

    The rules run once per distinct raw tuple, not once per line. The table of
    tuples is written and joined in the ordinary way: AQE broadcasts it within
    its byte threshold and else splits a tuple that is on very many lines.
    The product name is only looked at on lines where no field gave a category.
    """
    t = df.drop(*RESULT_COLUMNS)
    for c in RAW_COLUMNS:
        if c not in t.columns:
            t = t.withColumn(c, F.lit(None).cast("string"))
    keep = list(t.columns)
    table = hierarchy_table(t).select(*[F.col(f).alias(f"_t_{f}") for f in FIELDS], "_cat", "_cat_src", "_fam", "_fam_src")
    table = cut_lineage(table)  # measured when read; AQE broadcasts it within its byte threshold
    same = F.lit(True)
    for f in FIELDS:
        same = same & F.col(f).eqNullSafe(F.col(f"_t_{f}"))
    t = t.join(table, same, "left").drop(*[f"_t_{f}" for f in FIELDS])
    t = t.withColumn("_n_key", F.when(F.col("_cat").isNull(), _key(F.col("product_name"))))
    t = t.withColumn("_n_bare", _bare(F.col("_n_key")))
    t = t.withColumn("_n_cat", F.when(F.col("_n_key").isNotNull(), map_category(F.col("_n_key"), F.col("_n_bare"))))
    t = t.withColumns({
        "category_norm": F.coalesce("_cat", "_n_cat", F.lit(UNKNOWN)),
        "category_source": F.coalesce("_cat_src", F.when(F.col("_n_cat").isNotNull(), "product_name"), F.lit("unknown")),
        "category_signal_status": F.when(F.col("_cat").isNotNull(), "observed").when(F.col("_n_cat").isNotNull(), "inferred").otherwise("unknown"),
    })
    return t.select(
        *keep, *RESULT_COLUMNS[:3],
        F.coalesce("_fam", "category_norm").alias("product_family_v2"),
        F.coalesce("_fam_src", "category_source").alias("product_family_source"),
        F.when(F.col("_fam").isNotNull(), "observed").otherwise(F.col("category_signal_status"))
        .alias("product_family_signal_status"),
    )


def category_legacy(df: DataFrame, names: dict[str, str], unknown: str = UNKNOWN) -> DataFrame:
    """Older two-column rule: category name, else class name, else part of the class name."""
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    cat, klass = F.upper(clean_text(F.col("category_raw"))), F.upper(clean_text(F.col("class_raw")))
    part = F.lit(None).cast("string")
    for name, target in reversed(list(names.items())):
        part = F.when(klass.contains(name), target).otherwise(part)
    hit_cat, hit_class = lookup[cat], lookup[klass]
    return df.withColumns({
        "category": F.coalesce(hit_cat, hit_class, part, F.lit(unknown)),
        "category_method": F.when(hit_cat.isNotNull(), "category").when(hit_class.isNotNull(), "class")
        .when(part.isNotNull(), "class_part").otherwise("unknown"),
    })
