"""Column helpers: every one returns a ``Column`` and stays inside Catalyst.

Covers labels and predicates (P1-P3, P12), the scalar functions F1-F11 and the
hash-derived random keys used for reproducible draws (N4).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keras' binary cross-entropy clips probabilities by this epsilon (fixed value).
BCE_EPSILON = 1e-7


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- labels

def safe_pred(pred: Column) -> Column:
    """A predicate that is never null: null goes to the negative side."""
    return F.coalesce(pred, F.lit(False))


def greater(score, threshold: float, inclusive: bool = False) -> Column:
    """``score > t`` (or ``>=``) with Python semantics for NaN and null.

    Spark orders NaN above every number, so ``NaN > t`` is true there; the
    reference evaluates it in Python where it is false. A null score gives null, which
    a filter drops and ``label`` counts as 0: the bare comparison reaches the scan as a
    pushed filter. Negate ``safe_pred(greater(..))``, not this.
    """
    s = _col(score)
    cmp = s >= F.lit(threshold) if inclusive else s > F.lit(threshold)
    return cmp & ~F.isnan(s.cast("double"))


def label(pred: Column) -> Column:
    """Boolean predicate -> int label 1/0, null counted as 0."""
    return F.when(safe_pred(pred), F.lit(1)).otherwise(F.lit(0))


def binarize(prob, threshold: float = 0.5) -> Column:
    """``p > 0.5`` as int."""
    return label(_col(prob) > F.lit(threshold))


# --------------------------------------------------------------------------- hashing

def md5_key(seed: int, *cols) -> Column:
    """Hex md5 of ``'seed:c1[:c2...]'``; the same string in Spark and DuckDB."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts.append(F.lit(":"))
        parts.append(_col(c).cast("string"))
    return F.md5(F.concat(*parts))


def md5_uniform(seed: int, *cols) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits (52 bits) of md5_key."""
    key = md5_key(seed, *cols)
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") / F.lit(
        float(2**52)
    )


# --------------------------------------------------------------------------- scalar

def path_join(root: str, path) -> Column:
    """``os.path.join(root, path)``: an absolute path drops the root (F1)."""
    p = _col(path)
    r = root.rstrip("/") if root not in ("", "/") else root
    if root == "":
        return p
    sep = "" if r.endswith("/") else "/"
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(r + sep), p))


def parse_list(text, nested: bool = False) -> Column:
    """Text list ``'[0.1, 0.9]'`` -> ``array<double>`` (F2); nested lists flattened.

    ``nan``, ``inf`` and ``-inf`` (as Python writes them) are numbers; ``None`` is a null
    entry; any other text is an error, never a missing list. Null text gives null.
    """
    t = F.trim(_col(text))
    for word, name in (("nan", "NaN"), ("inf", "Infinity"), ("None", "null")):
        t = F.regexp_replace(t, rf"\b{word}\b", name)
    kind = "array<array<double>>" if nested else "array<double>"
    parsed = F.from_json(t, kind, {"allowNonNumericNumbers": "true"})
    wrong = _col(text).isNotNull() & (parsed.isNull() | ~t.startswith("[") | ~t.endswith("]"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("not a list of numbers: "), F.substring(t, 1, 80)))).otherwise(parsed)
    return F.flatten(checked) if nested else checked


def every_second_if_double(pred, truth) -> Column:
    """Keep every second value when ``pred`` has twice as many entries as ``truth``."""
    p, t = _col(pred), _col(truth)
    return F.when(
        F.size(p) == F.size(t) * 2, F.filter(p, lambda x, i: i % 2 == 1)
    ).otherwise(p)


def pair_step(a, b) -> Column:
    """s(a, b): 1 if a > b, 0 if a < b, 1/2 on ties."""
    a, b = _col(a), _col(b)
    return F.when(a > b, F.lit(1.0)).when(a < b, F.lit(0.0)).otherwise(F.lit(0.5))


def l2_distance(a, b) -> Column:
    """Euclidean distance of two numeric arrays, computed in double."""
    a = _col(a).cast("array<double>")
    b = _col(b).cast("array<double>")
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def l2_norm(a) -> Column:
    a = _col(a).cast("array<double>")
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def suffix_int(name, prefix_len: int = 4) -> Column:
    """``'knn-17'`` -> 17."""
    return F.substring(_col(name), prefix_len + 1, 1 << 20).cast("int")


def title_setting(name, part: int, sep: str = "_") -> Column:
    """Part ``part`` of ``'ava_aadb'`` upper-cased: part 0 -> 'AVA' (F7)."""
    return F.upper(F.element_at(F.split(_col(name), sep, -1), part + 1))


def round_even(c, digits: int = 2) -> Column:
    """Round half to even on the exact binary value, like Python's ``round`` (F8).

    Spark's ``bround`` rounds the shortest decimal string of a double (69.195 ->
    69.2) where Python rounds the binary value (69.19499... -> 69.19). Near a tie
    the sign of ``s x - (k + 1/2)`` is decided exactly with a Dekker split of x
    (both halves times ``s`` are exact products); elsewhere ``bround`` is right.
    """
    x = _col(c).cast("double")
    s = float(10**digits)
    y = x * F.lit(s)
    k = F.floor(y).cast("double")
    near_tie = F.abs(y - k - F.lit(0.5)) < F.lit(1e-6)
    split = F.lit(134217729.0) * x
    hi = split - (split - x)
    lo = x - hi
    d = (F.lit(s) * hi - (k + F.lit(0.5))) + F.lit(s) * lo
    down, up = k / F.lit(s), (k + F.lit(1.0)) / F.lit(s)
    even = F.when(F.pmod(k, F.lit(2.0)) == 0, down).otherwise(up)
    exact = F.when(d < 0, down).when(d > 0, up).otherwise(even)
    return F.when(x.isNull() | F.isnan(x), x).when(near_tie & (F.abs(y) < F.lit(2.0**52)), exact).otherwise(
        F.bround(x, digits)
    )


def format_setting(template: str, *cols) -> Column:
    """``'LAION+{}-{}'.format(a, b)`` for columns."""
    return F.format_string(template.replace("{}", "%s"), *[_col(c) for c in cols])


def zip_explode(x, y, names=("x", "y")):
    """Paired lists -> rows ``(pos, x, y)`` (F10). Lists of different lengths are an error:
    cutting the longer one would pair entries that do not belong together.

    Returns a column for ``select(*zip_explode(...))`` after an ``inline`` of the zipped
    array.
    """
    xs, ys = _col(x), _col(y)
    message = F.format_string("paired lists of %s and %s entries", F.size(xs), F.size(ys))
    zipped = F.arrays_zip(xs.alias(names[0]), ys.alias(names[1]))
    return F.posexplode(F.when(F.size(xs).eqNullSafe(F.size(ys)), zipped).otherwise(F.raise_error(message)))


def clipped_bce(y, p, eps: float = BCE_EPSILON) -> Column:
    """Binary cross-entropy with Keras clipping of the probability."""
    pc = F.least(F.greatest(_col(p).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    yv = _col(y).cast("double")
    return -(yv * F.log(pc) + (F.lit(1.0) - yv) * F.log(F.lit(1.0) - pc))


def bce_to(target: float, p, eps: float = BCE_EPSILON) -> Column:
    """BCE of probability ``p`` against a constant target 1 or 0."""
    pc = F.least(F.greatest(_col(p).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    return -F.log(pc) if target == 1 else -F.log(F.lit(1.0) - pc)
