"""Labels, patterns and constants that results depend on.

Everything in this file is a value, not logic. The operators take all of it as
parameters; the plans pass these as defaults.
"""

from __future__ import annotations

# Study period.
FIRST_YEAR = 2010
LAST_YEAR = 2023
PROJECTION_YEARS = tuple(range(2010, 2025))

# Sexes, in the order of the projection columns.
SEXES = ("Total", "Masculino", "Femenino")
MALE, FEMALE = "Masculino", "Femenino"

# Wide age bands, youngest first.
AGE_BANDS = (
    "<20 años",
    "20-39 años",
    "40-49 años",
    "50-59 años",
    "60-69 años",
    "70-79 años",
    "≥80 años",
)

# Five-year labels of the projections (first, last) per wide band.
PROJECTION_AGES = (
    (("0-4", "5-9", "10-14", "15-19"), None, "<20 años"),
    (None, ("20-24", "35-39"), "20-39 años"),
    (None, ("40-44", "45-49"), "40-49 años"),
    (None, ("50-54", "55-59"), "50-59 años"),
    (None, ("60-64", "65-69"), "60-69 años"),
    (None, ("70-74", "75-79"), "70-79 años"),
)

# Five-year labels of the standard population per wide band.
STANDARD_AGES = (
    (("15 a 19",), ("00 a 04", "10 a 14"), "<20 años"),
    (None, ("20 a 24", "35 a 39"), "20-39 años"),
    (None, ("40 a 44", "45 a 49"), "40-49 años"),
    (None, ("50 a 54", "55 a 59"), "50-59 años"),
    (None, ("60 a 64", "65 a 69"), "60-69 años"),
    (None, ("70 a 74", "75 a 79"), "70-79 años"),
    (("100 a 104", "105 y más", "100 y más"), ("80 a 84", "95 a 99"), "≥80 años"),
)
OLDEST_BAND = "≥80 años"

# Province number at the start of a projection label -> region.
PROVINCE_REGIONS = (
    ("^(02|06|14|30|82)", "Centro"),
    ("^(18|22|34|54)", "NEA"),
    ("^(38|66|90)", "NOA1"),
    ("^(10|86)", "NOA2"),
    ("^(46|50|70|74)", "Cuyo"),
    ("^(42|58|62)", "Patagonia Norte"),
    ("^(26|78|94)", "Patagonia Sur"),
)
REGIONS_TAKEN_WHOLE = "Cuyo|NOA1|NOA2|Pat"
PROVINCES_KEPT = "^(50|90)"
CAPITAL_LABEL, CAPITAL_NAME = "02-CABA", "CABA"

# Region label in the records -> region.
RECORD_REGIONS = (
    ("Cuyo", "Cuyo"),
    (r"^(3\.NOA1\.|4\.NOA\.)", "NOA1"),
    (r"^8\.Pat", "Patagonia Norte"),
    (r"^9\.Pat", "Patagonia Sur"),
)

# Jurisdiction number in the records -> jurisdiction.
RECORD_JURISDICTIONS = (
    ("(?<![0-9])0?6(?![0-9])", "Buenos Aires"),
    ("(?<![0-9])14(?![0-9])", "Córdoba"),
    ("(?<![0-9])30(?![0-9])", "Entre Ríos"),
    ("(?<![0-9])90(?![0-9])", "Tucumán"),
)
REST_OF_REGION = "(?<![0-9])99(?![0-9])"

# Labels of missing data in the records.
MISSING_REGION = "10.sin especificar."
MISSING_REGION_PATTERN = r"^10\."
MISSING_AGE = "08.sin especificar"

# Level-2 causes in reporting order, then residual groups.
CAUSES = (
    "Diabetes",
    "ECV",
    "ERC",
    "Neoplasias",
    "Otras ENT",
    "Homicidio",
    "Suicidio",
    "Tránsito",
    "Otras CE",
    "CMNN",
)
SUMMARY_CAUSES = (
    "CMNN",
    "Diabetes",
    "ECV",
    "ERC",
    "Neoplasias",
    "Otras ENT",
    "Homicidio",
    "Suicidio",
    "Tránsito",
    "Otras CE",
    "GC1-GC2",
    "GC3-GC4",
)
SUMMARY_GROUPS = ((("GC1", "GC2"), "GC1-GC2"), (("GC3", "GC4"), "GC3-GC4"))

# Label pattern -> level-1 group, first match wins.
LEVEL_ONE = (
    ("GC", "GC"),
    ("Dia|ECV|ERC|Neo|ENT", "ENT"),
    ("Hom|Sui|Trá|CE", "CE"),
)
BROAD_GROUPS = ("CE", "CMNN", "ENT", "GC")
LEVEL_TWO_CUT = "GC|CE"
RESIDUAL_PATTERN = "Neum|GC1|GC2"
SPECIFIC_PATTERN = "GC3-|GC4-"

# Target pools of the redistribution.
CHRONIC = "Dia|ECV|ERC|Neo"
EXTERNAL = "Hom|Sui|Tr|CE"
ILL_DEFINED = "GC"
PNEUMONIA = "GC4-Neumonías NE"

# Rates and density axis.
RATE_MULTIPLIER = 100000
DENSITY_LIMITS = (0, 150)
MAX_JOINPOINTS = 3
