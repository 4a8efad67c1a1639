"""Default rule tables.

FIXED VALUES: the strings, orders and constants below must equal the
evaluated study's definitions for results to match.  They are data, not
logic: every operator takes its rule table as a parameter and these are only
the defaults.  Order matters wherever a list is used (first match wins).
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Diagnosis text -> binary labels (substring tests on lower-cased, stripped text).
MELANOMA_TERMS = ["melanoma"]
MALIGNANT_TERMS = ["melanoma", "basal cell carcinoma", "squamous cell carcinoma"]

# Diagnosis text -> family: ordered substring rules; the first rule that hits wins.
FAMILY_RULES = [
    ("MEL", ["melanoma"]),
    ("BCC", ["basal cell carcinoma"]),
    ("NV", ["nevus", "naevus"]),
    ("BKL", ["seborrheic keratosis", "seborrhoeic keratosis"]),
    ("DF", ["dermatofibroma"]),
    ("VASC", ["vascular", "angioma", "hemangioma"]),
    ("SCCKA", ["squamous cell carcinoma"]),
]
# Variant with exact short codes: family -> codes that match the whole text.
FAMILY_EXACT_CODES = {"BCC": ["bcc"], "SCCKA": ["scc"]}
FAMILY_DEFAULT = "MISC"

# Reply family text (stripped, upper-cased) -> family; anything else is MISC.
FAMILY_ALIASES = {
    "MELANOMA": "MEL",
    "MEL": "MEL",
    "BCC": "BCC",
    "BASAL CELL CARCINOMA": "BCC",
    "NEVUS": "NV",
    "NAEVUS": "NV",
    "NV": "NV",
    "SEBORRHEIC KERATOSIS": "BKL",
    "SEBORRHOEIC KERATOSIS": "BKL",
    "SK": "BKL",
    "BKL": "BKL",
    "DF": "DF",
    "DERMATOFIBROMA": "DF",
    "VASC": "VASC",
    "VASCULAR": "VASC",
    "SCC": "SCCKA",
    "SCCKA": "SCCKA",
    "SQUAMOUS CELL CARCINOMA": "SCCKA",
    "MISC": "MISC",
    "MISCELLANEOUS": "MISC",
}

# The eight reply families, and the eleven families of the class-score model.
FAMILIES = ["MEL", "BCC", "NV", "BKL", "DF", "VASC", "SCCKA", "MISC"]
MODEL_FAMILIES = ["MEL", "BCC", "NV", "BKL", "DF", "VASC", "SCCKA",
                  "AKIEC", "MAL_OTH", "BEN_OTH", "INF"]
UNMAPPED_FAMILY = "NA"

# Family -> binary labels.
MELANOMA_FAMILIES = ["MEL"]
MALIGNANT_FAMILIES = ["MEL", "BCC", "SCCKA", "MAL_OTH"]
PREMALIGNANT_FAMILIES = ["AKIEC"]
BENIGN_FAMILIES = ["NV", "BKL", "DF", "INF", "VASC", "BEN_OTH"]

# Operating points found by Youden's J on the two base models.
SIIM_MEL_THRESHOLD = 0.16081724078112586
SIIM_MALIGNANCY_THRESHOLD = 0.14959644144798384
RESNET_MEL_THRESHOLD = 0.18557974882423878
RESNET_MALIGNANCY_THRESHOLD = 0.22138070850633085

# Two-class archive truth: class names and the token checked first.
TWO_CLASSES = ["melanoma", "melanocytic nevus"]
INDETERMINATE_TOKEN = "indeterminate"
MELANOMA_LABELS = ["non-melanoma", "melanoma"]
ARCHIVE_TRUTH_COLUMN = "metadata.clinical.diagnosis_1"

# Free-text diagnosis -> diagnosis group: ordered word-boundary rules on text
# normalised to [a-z0-9 ]; first hit wins; no hit -> null.
DX_GROUP_RULES = [
    (["melanoma", "melanoma in situ", "lentigo maligna"],
     "malignant melanocytic proliferations melanoma"),
    (["nevus", "naevus", "mole", "melanocytic nevus", "intradermal nevus", "junctional nevus",
      "compound nevus"],
     "benign melanocytic proliferations"),
    (["dysplastic nevus", "atypical nevus"],
     "benign melanocytic proliferations"),
    (["lentigo", "solar lentigo", "lentigines", "ephelis", "freckle"],
     "flat melanotic pigmentations not melanocytic nevus"),
    (["basal cell carcinoma", "bcc"],
     "malignant epidermal proliferations"),
    (["squamous cell carcinoma", "scc", "bowen"],
     "malignant epidermal proliferations"),
    (["actinic keratosis", "ak"],
     "malignant epidermal proliferations"),
    (["keratoacanthoma"],
     "malignant epidermal proliferations"),
    (["seborrheic keratosis", "seborrheic keratoses", "lichenoid keratosis"],
     "benign epidermal proliferations"),
    (["wart", "verruca"],
     "benign epidermal proliferations"),
    (["dermatofibroma", "fibrous histiocytoma"],
     "benign soft tissue proliferations fibro histiocytic"),
    (["hemangioma", "angioma", "venous lake", "pyogenic granuloma", "angiokeratoma", "vascular"],
     "benign soft tissue proliferations vascular"),
    (["mastocytoma", "mast cell"],
     "mast cell proliferations"),
    (["dermatitis", "eczema", "psoriasis", "tinea", "fungal", "infection", "impetigo",
      "folliculitis"],
     "inflammatory or infectious diseases"),
    (["tattoo", "foreign body", "exogenous"],
     "exogenous"),
    (["poroma", "hidradenoma", "spiradenoma", "syringoma"],
     "benign adnexal epithelial proliferations apocrine or eccrine"),
]

MALIGNANT_DX_GROUPS = [
    "malignant melanocytic proliferations melanoma",
    "malignant epidermal proliferations",
    "malignant adnexal epithelial proliferations follicular",
    "collision at least one malignant proliferation",
]

# Fillers used to pad a top-k list to k entries.
TOPK_FILLER_FAMILY = {"diagnosis": "", "family": "MISC", "probability": 0.0}
TOPK_FILLER_TWO_CLASS = {"diagnosis": "melanocytic nevus", "confidence": 0.0}

# Missing-value spellings a pandas CSV reader turns into NaN by default.
PANDAS_NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                     "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                     "nan", "null"]

# Image files: accepted extensions (case-insensitive) and resolution suffixes.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png"]
RESOLVE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".JPG", ".JPEG", ".PNG"]
ID_PREFIX = "ISIC_"
ID_PATTERN = r"(?i)ISIC_\d+"

# Fetch sources in order of preference.
FETCH_SOURCES = ["existing", "s3_jpg", "s3_png", "api_download"]

# Archive metadata columns placed first when widening nested records.
PREFERRED_METADATA_COLUMNS = [
    "isic_id",
    "name",
    "created",
    "updated",
    "image.width",
    "image.height",
    "metadata.diagnosis",
    "metadata.benign_malignant",
    "metadata.anatom_site_general",
    "metadata.patient_id",
    "_status",
    "_image_path",
]
# ------------------------------------------------------------ END FIXED VALUES
