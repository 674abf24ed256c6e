"""Compound-level operators: distinct compounds, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.functions import smiles as sm
from retort.schema import ROLES

# Standard atomic weights (IUPAC, rounded to 3 decimals; mass
# number of the longest-lived isotope where there is none), by atomic number.
_WEIGHT_TEXT = (
    "H 1.008 He 4.003 Li 6.94 Be 9.012 B 10.81 C 12.011 N 14.007 O 15.999 F 18.998 Ne 20.18 Na 22.99 "
    "Mg 24.305 Al 26.982 Si 28.085 P 30.974 S 32.06 Cl 35.45 Ar 39.95 K 39.098 Ca 40.078 Sc 44.956 Ti 47.867 "
    "V 50.942 Cr 51.996 Mn 54.938 Fe 55.845 Co 58.933 Ni 58.693 Cu 63.546 Zn 65.38 Ga 69.723 Ge 72.63 "
    "As 74.922 Se 78.971 Br 79.904 Kr 83.798 Rb 85.468 Sr 87.62 Y 88.906 Zr 91.224 Nb 92.906 Mo 95.95 Tc 98 "
    "Ru 101.07 Rh 102.906 Pd 106.42 Ag 107.868 Cd 112.414 In 114.818 Sn 118.71 Sb 121.76 Te 127.6 I 126.904 "
    "Xe 131.293 Cs 132.905 Ba 137.327 La 138.905 Ce 140.116 Pr 140.908 Nd 144.242 Pm 145 Sm 150.36 "
    "Eu 151.964 Gd 157.25 Tb 158.925 Dy 162.5 Ho 164.93 Er 167.259 Tm 168.934 Yb 173.045 Lu 174.967 "
    "Hf 178.486 Ta 180.948 W 183.84 Re 186.207 Os 190.23 Ir 192.217 Pt 195.084 Au 196.967 Hg 200.592 "
    "Tl 204.38 Pb 207.2 Bi 208.98 Po 209 At 210 Rn 222 Fr 223 Ra 226 Ac 227 Th 232.038 Pa 231.036 U 238.029 "
    "Np 237 Pu 244 Am 243 Cm 247 Bk 247 Cf 251 Es 252 Fm 257 Md 258 No 259 Lr 262 Rf 267 Db 268 Sg 269 "
    "Bh 270 Hs 269 Mt 278 Ds 281 Rg 282 Cn 285 Nh 286 Fl 289 Mc 290 Lv 293 Ts 294 Og 294")
_FIELDS = _WEIGHT_TEXT.split()
ATOMIC_WEIGHTS = [(s, float(w)) for s, w in zip(_FIELDS[::2], _FIELDS[1::2])]


def distinct_compounds(clean: DataFrame, cols=None) -> DataFrame:
    """Distinct '.'-fragments over role and product columns -> (smiles)."""
    cols = cols or ROLES + ["PRODUCT"]
    v = clean.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("v")).where(F.col("v").isNotNull())
    return v.select(F.explode_outer(F.split("v", r"\.")).alias("smiles")).where(F.col("smiles").isNotNull()).distinct()


def heavy_atom_weight(df: DataFrame, col: str = "smiles", out: str = "heavy_weight") -> DataFrame:
    """Sum of atomic weights of the explicit heavy atoms of each distinct compound.

    Hydrogen is not a heavy atom and never counts, explicit or implicit.  A
    compound with an atom that is no element has a null weight; one without
    any heavy atom weighs 0.  Atoms are matched against the 118 elements
    (a map of fixed size in the plan).
    """
    table = F.create_map(*[F.lit(x) for pair in ATOMIC_WEIGHTS for x in pair])
    atoms = df.select(col, F.explode_outer(sm.atom_symbols(col)).alias("a"))
    symbol = F.concat(F.upper(F.substring("a", 1, 1)), F.substring("a", 2, 10))
    weight = F.when(F.col("a").isNull() | (symbol == "H"), F.lit(0.0)).otherwise(table[symbol])
    total = F.when(F.count_if(weight.isNull()) == 0, F.round(F.sum(weight), 4))
    return atoms.groupBy(col).agg(total.alias(out))
