"""Monomer library and default screening grids (small dimension inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

# ---- fixed values: external monomer library of the reference, in its order ----
# (name, SMILES, description); 24 aqueous amines then 8 organic acyl chlorides.
EXTERNAL_MONOMERS = [
    ("PIP", "C1CNCCN1", "哌嗪（经典 NF 水相单体）"),
    ("2-MePIP", "CC1CNCCN1", "2-甲基哌嗪"),
    ("2,5-DMPIP", "CC1CNC(C)CN1", "2,5-二甲基哌嗪"),
    ("AMPIP", "NCC1CNCCN1", "氨甲基哌嗪"),
    ("HPIP", "OCCN1CCNCC1", "羟乙基哌嗪"),
    ("MPD", "Nc1cccc(N)c1", "间苯二胺（RO 经典）"),
    ("PPD", "Nc1ccc(N)cc1", "对苯二胺"),
    ("OPD", "Nc1ccccc1N", "邻苯二胺"),
    ("TAB", "Nc1cc(N)cc(N)c1", "1,3,5-三氨基苯"),
    ("EDA", "NCCN", "乙二胺"),
    ("DETA", "NCCNCCN", "二乙烯三胺"),
    ("TETA", "NCCNCCNCCN", "三乙烯四胺"),
    ("TEPA", "NCCNCCNCCNCCN", "四乙烯五胺"),
    ("PDA-1,3", "NCCCN", "1,3-丙二胺"),
    ("BDA", "NCCCCN", "1,4-丁二胺"),
    ("HDA", "NCCCCCCN", "1,6-己二胺"),
    ("JEFFAMINE", "NCCCOCCOCCCN", "醚二胺（柔性链）"),
    ("TRIS", "NC(CO)(CO)CO", "三羟甲基氨基甲烷"),
    ("BAC", "NCC1CCC(CN)CC1", "1,4-环己烷二甲胺"),
    ("IPD", "CC1(C)CC(N)CC(C)(CN)C1", "异佛尔酮二胺"),
    ("DAPP", "NCCCN1CCN(CCCN)CC1", "双氨丙基哌嗪"),
    ("TAEA", "NCCN(CCN)CCN", "三(2-氨乙基)胺"),
    ("PEHA", "NCCNCCNCCNCCNCCN", "五乙烯六胺"),
    ("SPD", "NCCCNCCCCNCCCN", "亚精胺类多胺"),
    ("TMC", "O=C(Cl)C1=CC(C(=O)Cl)=CC(C(=O)Cl)=C1", "均苯三甲酰氯（经典）"),
    ("IPC", "O=C(Cl)c1cccc(C(=O)Cl)c1", "间苯二甲酰氯"),
    ("TPC", "O=C(Cl)c1ccc(C(=O)Cl)cc1", "对苯二甲酰氯"),
    ("BTEC", "O=C(Cl)c1cc(C(=O)Cl)c(C(=O)Cl)cc1C(=O)Cl", "均苯四甲酰氯"),
    ("ADC", "O=C(Cl)CCCCC(=O)Cl", "己二酰氯（脂肪族）"),
    ("SEC", "O=C(Cl)CCCCCCCC(=O)Cl", "癸二酰氯"),
    ("CHDC", "O=C(Cl)C1CCC(C(=O)Cl)CC1", "环己烷二甲酰氯"),
    ("BPC", "O=C(Cl)c1ccc(-c2ccc(C(=O)Cl)cc2)cc1", "联苯二甲酰氯"),
]
NAME_SEPARATOR = "｜"   # display name = name + separator + description

# ---- fixed values: default grids of the reference's screening requests ----
RECIPE_GRID = {"D1": [0.2, 0.5, 1.0, 1.5, 2.0], "D2": [0.10, 0.15, 0.20, 0.30],
               "T1": [60.0, 120.0, 300.0], "T2": [30.0, 60.0, 120.0]}
RECIPE_GRID_LIMIT = 20000
MONOMER_GRID = {"D1": [0.5, 1.0, 2.0], "D2": [0.15, 0.30], "T1": [120.0, 300.0],
                "T2": [60.0]}
MONOMER_CONTEXT = {"membrane": "Psf", "wca": 48.0, "zeta": 14.0, "pore": 0.40,
                   "mwco": 360.0, "thickness": 81.0, "pressure": 10.0, "feed": 2000.0}

_LIB_SCHEMA = StructType([StructField("name", StringType(), False),
                          StructField("smiles", StringType(), False),
                          StructField("description", StringType(), False)])


def monomer_library(spark: SparkSession) -> DataFrame:
    """The 32-row library as a DataFrame (a constant-size dimension)."""
    return spark.createDataFrame(EXTERNAL_MONOMERS, _LIB_SCHEMA)
