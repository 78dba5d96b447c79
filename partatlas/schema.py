"""Item columns, defaults, parameters and rule tables."""

CATALOG = "catalog_no"
DESCRIPTION = "description"
MAIN = "main_category"
SUB = "sub_category"
MFR = "mfr_code"
ENRICHED = "enriched_description"
CLUSTER = "cluster"
ROW = "row_id"

# Headings of the item files users have today, and our names for them.
FILE_COLUMNS = {
    "CatalogNo": CATALOG,
    "Description": DESCRIPTION,
    "Main Category": MAIN,
    "Sub-category": SUB,
    "MfrCode": MFR,
    "Enriched Description": ENRICHED,
    "Cluster": CLUSTER,
}

KEY_COLUMNS = [CATALOG, DESCRIPTION, MFR, MAIN, SUB]
REQUIRED_COLUMNS = [CATALOG, DESCRIPTION]
MODEL_COLUMNS = [DESCRIPTION, MAIN, SUB, CATALOG]
CLUSTER_COLUMNS = [DESCRIPTION, MAIN, SUB]

UNKNOWN = "Unknown"
UNCATEGORIZED = "Uncategorized"
EMPTY_CATALOG = "EMPTY"

# Weights, thresholds and model sizes.
SKU_WEIGHT = 0.4
DESC_WEIGHT = 0.6
SIMILARITY_THRESHOLD = 0.8
NETWORK_THRESHOLD = 0.5
CONFIDENCE_THRESHOLD = 0.8
TFIDF_MAX_FEATURES = 1000
SVD_COMPONENTS = 100
FOREST_TREES = 100
KMEANS_CLUSTERS = 10
KMEANS_SEED = 42
DBSCAN_MIN_NEIGHBOURS = 3
ENRICHED_SHARE = 0.8
SUBSET_ROWS = 1000
TOP_SUBCATEGORIES = 20
LABEL_EVERY = 10

# Scores are rounded to this many digits before they are compared with a
# threshold or with each other, so that the order of a sum never decides.
DIGITS = 9

# Exact manufacturer codes and the names they stand for.
MANUFACTURER_NAMES = {
    "DOT": "Dottie",
    "CH": "Eaton",
    "BLINE": "Cooper B-Line",
    "MIL": "Milbank",
    "LEV": "Leviton",
    "ITE": "Siemens",
    "GEIND": "General Electric Industrial",
    "UNIPA": "Union Pacific",
    "GARV": "Garvin Industries",
    "FIT": "American Fittings",
    "TAY": "TayMac",
    "ARL": "Arlington",
    "AMFI": "American Fittings",
    "BPT": "Bridgeport",
    "CCHO": "Eaton Course-Hinds",
    "HARGR": "Harger",
    "CARLN": "Carlon",
    "MULB": "Mulberry",
    "SOLAR": "Solarline",
    "ENERL": "Enerlites",
    "HUBWD": "Hubble Wiring Device",
    "DMC": "DMC Power",
    "INT": "Intermatic",
    "LUT": "Lutron",
    "LITTE": "Littelfuse",
    "GRNGA": "GreenGate",
    "WATT": "Wattstopper",
    "SENSO": "Sensor Switch",
    "CHE": "Eaton Crouse Hinds",
    "OZ": "OZ Gedney",
}

# Catalogue-number prefixes per manufacturer, first match wins.
MANUFACTURER_PREFIXES = {
    "ABB": ["ABB", "1SDA"],
    "SIEMENS": ["3VA", "3VL", "3RV"],
    "SCHNEIDER": ["LV4", "NSX", "CVS"],
    "EATON": ["NZMN", "NZMP", "PKZ"],
    "GE": ["FE", "FD", "FB"],
    "MITSUBISHI": ["NF", "WS"],
    "CHINT": ["NM8", "NM1"],
    "LEGRAND": ["DPX", "DMX"],
    "HYUNDAI": ["HGM", "HMD"],
    "LS": ["TS", "TD"],
}
