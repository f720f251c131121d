"""Names and lookup tables that results must agree on."""

# The fourteen findings, in published order.
FINDINGS = [
    "No Finding", "Enlarged Cardiomediastinum", "Cardiomegaly", "Lung Lesion", "Lung Opacity",
    "Edema", "Consolidation", "Pneumonia", "Atelectasis", "Pneumothorax", "Pleural Effusion",
    "Pleural Other", "Fracture", "Support Devices",
]
LABEL_SYNONYMS = {"Airspace Opacity": "Lung Opacity"}
LABEL_NAMES = {0: "Negative", 1: "Positive", -1: "Uncertain", -9: "Disagreement"}

# View from the recorded view position.
VIEW_BY_POSITION = {
    "AP": "frontal",
    "PA": "frontal",
    "LATERAL": "lateral",
    "LL": "lateral",
    "LPO": "other",
    "RAO": "other",
    "RPO": "other",
    "LAO": "other",
    "AP AXIAL": "other",
    "XTABLE LATERAL": "other",
    "AP LLD": "other",
    "PA LLD": "other",
    "L5 S1": "other",
    "SWIMMERS": "other",
    "AP RLD": "other",
    "PA RLD": "other",
}

# View from the device processing description.
VIEW_BY_DESCRIPTION = {
    "CHEST, LATERAL": "lateral",
    "CHEST, PA": "frontal",
    "CHEST, PORTABLE": "frontal",
    "CHEST, PA X-WISE": "frontal",
    "CHEST, AP (GRID)": "frontal",
    "CHEST LAT": "lateral",
    "CHEST PA": "frontal",
    "CHEST, AP NON-GRID": "frontal",
    "CHEST AP NON GRID": "frontal",
    "CHEST PA X-WISE": "frontal",
    "CHEST AP GRID": "frontal",
    "CHEST, PORTABLE X-WISE": "other",
    "CHEST PORT": "frontal",
    "CHEST PORT X-WISE": "frontal",
    "SHOULDER": "other",
    "CHEST, PEDI (4-10 YRS)": "other",
    "LOWER RIBS": "other",
    "CHEST, DECUB.": "other",
    "ABDOMEN, PORTABLE": "other",
    "UPPER RIBS": "frontal",
    "STERNUM, LATERAL": "lateral",
    "KNEE, AP/OBL": "other",
    "STERNUM, PA/OBL.": "other",
    "CLAVICLE/ AC JOINTS": "other",
    "ABDOMEN,GENERAL": "other",
    "LOWER RIB": "other",
    "SCOLIOSIS AP": "frontal",
}
KNOWN_VIEWS = ["frontal", "lateral"]

# Section names, and the spellings seen for them.
SECTION_SYNONYMS = {
    "preamble": "preamble",
    "impression": "impression",
    "comparison": "comparison",
    "indication": "indication",
    "findings": "findings",
    "examination": "examination",
    "technique": "technique",
    "history": "history",
    "comparisons": "comparison",
    "clinical history": "history",
    "reason for examination": "indication",
    "notification": "notification",
    "reason for exam": "indication",
    "clinical information": "history",
    "exam": "examination",
    "clinical indication": "indication",
    "conclusion": "impression",
    "chest, two views": "findings",
    "recommendation(s)": "recommendations",
    "type of examination": "examination",
    "reference exam": "comparison",
    "patient history": "history",
    "addendum": "addendum",
    "comparison exam": "comparison",
    "date": "date",
    "comment": "comment",
    "findings and impression": "impression",
    "wet read": "wet read",
    "comparison film": "comparison",
    "recommendations": "recommendations",
    "findings/impression": "impression",
    "pfi": "history",
    "recommendation": "recommendations",
    "wetread": "wet read",
    "ndication": "impression",
    "impresson": "impression",
    "imprression": "impression",
    "imoression": "impression",
    "impressoin": "impression",
    "imprssion": "impression",
    "impresion": "impression",
    "imperssion": "impression",
    "mpression": "impression",
    "impession": "impression",
    "findings/ impression": "impression",
    "finding": "findings",
    "findins": "findings",
    "findindgs": "findings",
    "findgings": "findings",
    "findngs": "findings",
    "findnings": "findings",
    "finidngs": "findings",
    "idication": "indication",
    "reference findings": "findings",
    "comparision": "comparison",
    "comparsion": "comparison",
    "comparrison": "comparison",
    "comparisions": "comparison",
}

# Names looked for inside an unlisted heading, first hit wins.
CONTAINED_NAMES = ["impression", "findings", "history", "comparison", "addendum"]

# Phrases that mark an unlisted heading as findings.
VIEW_PHRASES = [
    "chest", "portable", "pa and lateral", "lateral and pa", "ap and lateral", "lateral and ap",
    "frontal and", "two views", "frontal view", "pa view", "ap view", "one view", "lateral view",
    "bone window", "frontal upright", "frontal semi-upright", "ribs", "pa and lat",
]

# Fixed value: a section heading.
SECTION_HEADING = r"(?U)\n ([A-Z ()/,-]+):\s"
CONCLUSION_ORDER = ["impression", "findings", "last_paragraph", "comparison"]

# A date inside a report, with the month names it may hold.
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
)
DATE = (
    r"(?U)(\b\d{1,2}\s*[-\/]\s*\d{1,2}(?:\s*[-\/]\s*\d{2,4})?\b"
    r"|\b(?:\d{1,2}(?:st|nd|rd|th)?\s+)?(?:" + MONTHS + r")"
    r"(?:\s+\d{1,2}(?:st|nd|rd|th)?)?(?:\s*,?\s*\d{2,4})?\b)"
)

# Characters swallowed before a date, and the two runs after it.
BEFORE_DATE = r"""[}+@*(^)\d%;&:"\-#\s,.'\w/]"""
AFTER_DATE_1 = r"[\s*\d,.;)@]"
AFTER_DATE_2 = r"""[\w*\s\-:/)';&"%#^}]"""
BROKEN_CHUNK = "2(004)"

# Spacing of punctuation after tokens are joined.
CLOSE_UP = [" .", " ,", " :", " ;"]
SPREAD_OUT = [(").", ") ."), ("%.", "% ."), (".'", ". '"), ("%,", "% ,"), ("%)", "% )")]

# Columns tried in turn for the text of a table.
TEXT_COLUMNS = ["text", "content", "sentence", "review", "comment", "document"]

# Nested keys (tag numbers in decimal) read from sequence JSON.
CODE_MEANING = "524548"
SEQUENCE_COLUMNS = {
    "528434": "ProcedureCodeSequence_CodeMeaning",
    "5505568": "ViewCodeSequence_CodeMeaning",
    "5506064": "PatientOrientationCodeSequence_CodeMeaning",
}
TAG_COLUMNS = {
    "4194900": "PerformedProcedureStepDescription",
    "1593601": "ViewPosition",
    "2621456": "Rows",
    "2621457": "Columns",
    "524320": "StudyDate",
    "524336": "StudyTime",
    "1577984": "AcquisitionDeviceProcessingDescription",
}
LONGEST_VALUE = 100

# First bytes of the accepted image formats.
IMAGE_MAGIC = ["FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961"]
WEBP_MAGIC_AT_8 = "57454250"
SMALLEST_IMAGE = 100
IMAGE_SUFFIXES = ["png", "jpg", "jpeg"]

# Splits of an instruction set.
SPLITS = ["train", "val", "test"]
