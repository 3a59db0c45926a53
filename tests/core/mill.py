"""An invented survey of water mills, clean but for what a test plants: mills, their grinds, the sacks of a grind."""

from plumbline.sources.spec_files import column_map, read_spec

COLUMNS = column_map(
    table="sheet", attribute="item", type="holds", key="role", reference="points_to", lookup="one_of",
    min="least", max="most", min_inclusive="least_in", max_inclusive="most_in", pattern="shape", max_length="letters", decimals="digits", lineage="origin",
)
FIELDS = ["sheet", "item", "holds", "role", "points_to", "one_of", "least", "most", "least_in", "most_in", "shape", "letters", "digits", "origin"]


def item(sheet, name, holds, **more):
    return dict.fromkeys(FIELDS) | {"sheet": sheet, "item": name, "holds": holds} | more


DICTIONARY = [
    item("mills", "mill_no", "words", role="PK"),
    item("mills", "built", "date_dmy"),
    item("mills", "wheel", "measure", least="0.5", most="12", digits="2"),
    item("mills", "valley", "words", one_of="valley"),
    item("mills", "title", "words", shape="^[A-Z][a-z]+( [0-9]+)?$", letters="30"),
    item("grinds", "grind_no", "words", role="PK"),
    item("grinds", "mill_no", "words", role="FK", points_to="mills"),
    item("grinds", "turns", "count", least="5", most="900"),
    item("grinds", "moisture", "measure", least="0", most="40", digits="1"),
    item("grinds", "grain", "words", one_of="grain"),
    item("grinds", "old_grind_ref", "words", origin="y"),
    item("sacks", "sack_no", "words", role="PK"),
    item("sacks", "grind_no", "words", role="FK", points_to="grinds"),
    item("sacks", "mass", "measure", least="2", most="80", least_in="no", digits="2"),
    item("sacks", "grade", "words", one_of="grade"),
]
TYPES = [{"data_type": "words", "r_class": "character"}, {"data_type": "measure", "r_class": "double"}, {"data_type": "count", "r_class": "integer"}, {"data_type": "date_dmy", "r_class": "character", "date_format": "%d.%m.%Y"}]
MISSING = [(family, reason, code, False, reason == "not_applicable") for family, codes in (("numeric", ("-77", "-66")), ("character", ("#", "%")), ("date", ("#", "%"))) for reason, code in zip(("missing", "not_applicable"), codes, strict=True)]
VALLEYS, GRAINS, GRADES = ("EAST", "NORTH", "WEST"), ("BAR", "OAT", "RYE", "SPE"), ("A1", "A2", "B1")
LISTS = {"valley": [{"valley": x} for x in VALLEYS], "grain": [{"grain": x} for x in GRAINS], "grade": [{"grade": x} for x in GRADES]}
REACH = [("mills", None, "root"), ("grinds", "mill_no", "from_parent"), ("sacks", "grind_no", "from_parent")]


def mill_spec(**more):
    reach = [{"table_name": t, "attribute_name": a, "how": h} for t, a, h in REACH]
    return read_spec(DICTIONARY, columns=COLUMNS, types=TYPES, missing=MISSING, code_lists=LISTS, id_pattern="^old_.*_ref$", reach=reach, **more)


def rows(sacks=36):
    return {
        "mills": [(f"M{k}", f"{k + 1:02d}.06.{1840 + k}", 2.25 + k, VALLEYS[k % 3], f"Mill {k}") for k in range(9)],
        "grinds": [(f"G{k}", f"M{k % 9}", 20 + k, 10.5, GRAINS[k % 4], f"{k}-w") for k in range(18)],
        "sacks": [(f"K{k}", f"G{k % 18}", 20.25 + k / 4, GRADES[k % 3]) for k in range(sacks)],
    }


SCHEMAS = {
    "mills": "mill_no string, built string, wheel double, valley string, title string",
    "grinds": "grind_no string, mill_no string, turns int, moisture double, grain string, old_grind_ref string",
    "sacks": "sack_no string, grind_no string, mass double, grade string",
}


def edit(data, table, key, column, value):
    """Set a cell of the record with a key."""
    at = [x.split()[0] for x in SCHEMAS[table].split(", ")].index(column)
    data[table] = [(*r[:at], value, *r[at + 1 :]) if r[0] == key else r for r in data[table]]


def frames(spark, data, folder):
    out = {}
    for t, x in data.items():
        spark.createDataFrame(x, SCHEMAS[t]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        out[t] = spark.read.parquet(f"{folder}/{t}.parquet")
    return out


LINEAGE = [{"contributor_label": "EAST", "table_name": "grinds", "attribute_name": "old_grind_ref", "source_text": "book.page + book.line"}, {"contributor_label": "NORTH", "table_name": "grinds", "attribute_name": "old_grind_ref", "source_text": "#"}]
