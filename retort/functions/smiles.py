"""Compound-string expressions (pure Spark defaults, not a chemistry toolkit).

Nothing here parses molecules.  The defaults are *syntax-level* stand-ins
so every job runs and is oracle-checkable without a chemistry library:

* ``is_valid_smiles``  — token grammar covers the text, parentheses
  balance, ring closures (digits and %nn) pair up.  Not a valence or
  aromaticity check; empty branches and doubled bonds pass.
* ``canonical_fragments`` — fragment normal form: atom maps stripped,
  fragments sorted, rejoined; null when any fragment fails the syntax
  check.  Not a canonical SMILES; exact chemistry plugs in through
  ``retort.plans.dictionary.dictionary_apply`` with a user function.
* ``fragment_shuffle`` — seeded fragment permutation (the reference picks a
  random root atom per fragment; we only permute fragments).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SMILES token grammar used by the syntax check (organic
# subset atoms, aromatic atoms, bracket atoms, bonds, branches, ring closures).
TOKEN_PATTERN = r"\[[^\[\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops]|\*|[-=#$:/\\]|[()]|%[0-9][0-9]|[0-9]"
BRACKET_ATOM = r"\[[^\[\]]*\]"
ATOM_MAP = r"(\[[^\[\]:]*):[0-9]+\]"
# Atom symbols for weights: bracket element symbols or organic-subset atoms.
ATOM_SYMBOL = r"\[[0-9]*([A-Z][a-z]?|[a-z][a-z]?)|(Br|Cl|[BCNOPSFI]|[bcnops])"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_atom_maps(c) -> Column:
    """Remove ':n' map numbers from bracket atoms: '[CH3:1]O' -> '[CH3]O'."""
    return F.regexp_replace(_c(c), ATOM_MAP, "$1]")


def _paren_depth_ok(f: Column) -> Column:
    depth = F.aggregate(
        F.split(f, ""), F.lit(0),
        lambda acc, ch: F.when(acc < 0, acc)
        .when(ch == "(", acc + 1)
        .when(ch == ")", acc - 1)
        .otherwise(acc))
    return depth == 0


def _rings_paired(f: Column) -> Column:
    """Every ring-closure number (one digit, or '%nn'; outside bracket atoms) occurs an even number of times.

    The sorted closures are folded with the one that waits for its partner.
    """
    closures = F.array_sort(F.regexp_extract_all(F.regexp_replace(f, BRACKET_ATOM, ""), F.lit("%[0-9][0-9]|[0-9]"), 0))
    waiting = F.aggregate(closures, F.lit(""), lambda acc, x: F.when(acc == "", x).when(acc == x, F.lit("")).otherwise(F.lit("!")))
    return waiting == ""


def fragment_is_valid(f: Column) -> Column:
    """Syntax check of one '.'-free fragment (see module docstring)."""
    return ((F.length(f) > 0)
            & (F.regexp_replace(f, TOKEN_PATTERN, "") == "")
            & f.rlike("[A-Za-z*]")
            & _paren_depth_ok(f)
            & _rings_paired(f))


def fragments(c) -> Column:
    return F.split(_c(c), r"\.")


def is_valid_smiles(c) -> Column:
    """True when every '.'-fragment passes the syntax check; null in -> null."""
    return F.forall(fragments(c), fragment_is_valid)


def canonical_fragments(c) -> Column:
    """Default canonicaliser: strip maps, sort fragments; null if any is invalid."""
    fr = fragments(c)
    normal = F.array_join(F.array_sort(F.transform(fr, strip_atom_maps)), ".")
    return F.when(F.forall(fr, fragment_is_valid), normal)


def canonical_or_blank(c) -> Column:
    """The corpus guard: ' ' stays ' ', anything else is canonicalised."""
    x = _c(c)
    return F.when(x == F.lit(" "), x).otherwise(canonical_fragments(x))


def fragment_shuffle(c, seed: int = 42) -> Column:
    """Seeded permutation of the fragments of a valid compound string; null on failure.

    The permutation key is md5(seed|text|position), so it is reproducible
    and the same in any engine that has md5.
    """
    x = _c(c)
    fr = fragments(x)
    keyed = F.transform(fr, lambda f, i: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), x, i.cast("string"))).alias("k"), f.alias("f")))
    shuffled = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["f"]), ".")
    return F.when(F.forall(fr, fragment_is_valid), shuffled)


def atom_symbols(c) -> Column:
    """Heavy-atom symbols of a compound (bracket element or organic-subset atom)."""
    x = _c(c)
    bracket = F.regexp_extract_all(x, F.lit(r"\[[0-9]*([A-Z][a-z]?|[a-z][a-z]?)"), 1)
    organic = F.regexp_extract_all(F.regexp_replace(x, BRACKET_ATOM, ""),
                                   F.lit(r"(Br|Cl|[BCNOPSFI]|[bcnops])"), 1)
    return F.concat(bracket, organic)
