"""Lookup tables: stopwords, languages and countries, names, translation models, labels, language groups.

All are of fixed size. Wide ones are Parquet files of the package, read once on the driver and sent to executors as local
relations, so no executor needs the package's folder.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

FOLDER = Path(__file__).parent / "tables"

COARSE = {
    fine: coarse
    for coarse, fines in {
        "DISEASE": "MEDICAL_SYMPTOM",
        "LOC": "FAC GPE LOCATION",
        "NORP": "LANGUAGE POLITICAL_PARTY_MEMBER POLITICAL_PARTY RACE RELIGION_MEMBER RELIGION SOC_ECO_CLASS UNION_MEMBER UNION",
        "OTHER": "PERSON_PRONOUN TITLE",
        "SUBSTANCE": "CHEMICAL_SUBSTANCE",
    }.items()
    for fine in fines.split()
}
LABELS = tuple(
    "ADDRESS AGE ANAT ANIMAL BIO_CHEM_ENTITY DATE DISEASE EVENT FOOD GENDER ID IP_ADDRESS JOB LAW LICENSE_PLATE LOC MEDICAL_THERAPY "
    "MISC NORP ORG OTHER PERSON PHONE PLANT PRODUCT PUBLIC_FIGURE QUANTITY SUBSTANCE TIME URL USER".split()
)
PARENT = {"ADDRESS": "LOC", "IP_ADDRESS": "ID", "LICENSE_PLATE": "ID", "NORP": "ORG", "PHONE": "ID", "PUBLIC_FIGURE": "PERSON"}

#: (languages that ask for the group, languages that the group has besides); the first that fits is taken.
_GROUPS = [
    ("ig ny rw sn so st sw xh yo zu", ""),
    ("hi mr ne", ""),
    ("br fr", "la"),
    ("pt", "gl la"),
    ("an ca eo es eu gl oc", "la"),
    ("ar arz az azb ckb fa ps ur", ""),
    ("id ms", ""),
    ("as bn bpy", ""),
    ("af nl", ""),
    ("bo dz", ""),
    ("bs hr", ""),
    ("bxr mn", ""),
    ("ceb tl", ""),
    ("cs sk", ""),
    ("da no", ""),
    ("eml wa", ""),
    ("de dsb lb pl", ""),
    ("jv", "id ms tl"),
    ("av ba be bg ce cv kk ky ru uk", ""),
]
#: Locales for which invented names can be asked; the language is what precedes the underscore.
LOCALES = tuple(
    "ar_AA,PS,SA bg_BG cs_CZ de_AT,CH,DE dk_DK el_GR en_GB,IE,IN,NZ,TH,US es_CA,ES,MX et_EE fa_IR fi_FI fr_CA,CH,FR,QC ga_IE he_IL hi_IN hr_HR hu_HU "
    "hy_AM id_ID it_IT ja_JP ka_GE ko_KR lt_LT lv_LV ne_NP nl_NL no_NO or_IN pl_PL pt_BR,PT ro_RO ru_RU sl_SI sv_SE ta_IN th_TH tr_TR tw_GH uk_UA zh_CN,TW".split()
)
_FALLBACK = {"eu": "es", "ca": "es"} | dict.fromkeys(("as", "gu", "pa", "bn", "ur"), "hi")
_BRITISH = frozenset("vi mr yo sw sn st ig ny xh zu".split())


@cache
def table(name: str) -> pa.Table:
    return pq.read_table(FOLDER / f"{name}.parquet")


def frame(spark: SparkSession, name: str) -> DataFrame:
    """A lookup table as a DataFrame."""
    return spark.createDataFrame(table(name))


@cache
def stopwords() -> dict[str, frozenset[str]]:
    out: dict[str, set] = {}
    for r in table("stopwords").to_pylist():
        out.setdefault(r["lang"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in out.items()}


@cache
def name_lists() -> dict[str, tuple[str, ...]]:
    out: dict[str, list] = {}
    for r in sorted(table("names").to_pylist(), key=lambda r: (r["list"], r["place"])):
        out.setdefault(r["list"], []).append(r["name"])
    return {k: tuple(v) for k, v in out.items()}


def ancestors(label: str) -> tuple[str, ...]:
    """The label and those above it; a label that isn't listed has none."""
    return tuple(x for x in (label, PARENT.get(label)) if x) if label in LABELS else ()


def ontology() -> list[tuple[str, str]]:
    return [(x, y) for x in LABELS for y in ancestors(x)]


def language_group(lang: str) -> frozenset[str]:
    """Languages that are easily taken for ``lang``, itself included."""
    for asks, more in _GROUPS:
        if lang in asks.split():
            return frozenset(f"{asks} {more}".split())
    return frozenset([lang])


def grouped_languages() -> list[tuple[str, str]]:
    """(language, member of its group) of all languages that are in a group with others."""
    return [(x, y) for x in sorted({x for asks, _ in _GROUPS for x in asks.split()}) for y in sorted(language_group(x))]


def locales(lang: str) -> tuple[str, ...]:
    """Locales from which names for a language are taken; the language's own, or those of a related one."""
    if lang in _BRITISH:
        return ("en_GB",)
    lang = _FALLBACK.get(lang, lang)
    return tuple(f"{lang}_{x}" for row in LOCALES if row.split("_")[0] == lang for x in row.split("_")[1].split(","))
