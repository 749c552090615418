"""Probability vectors as array<double> columns: higher-order functions only, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(v: Column | str) -> Column:
    return F.aggregate(c(v), F.lit(0.0), lambda a, x: a + x)


def normalize(v: Column | str) -> Column:
    """L1; a zero vector stays as it is."""
    s = total(v)
    return F.transform(c(v), lambda x: F.when(s == 0, x).otherwise(x / s))


def smooth(counts: Column | str, alpha: float | list[float]) -> Column:
    """(n_k + alpha_k) / (n + sum alpha): the posterior mean of a topic distribution."""
    a = F.array(*[F.lit(float(x)) for x in alpha]) if isinstance(alpha, list) else None
    up = F.zip_with(c(counts).cast("array<double>"), a, lambda x, y: x + y) if a is not None else F.transform(c(counts).cast("array<double>"), lambda x: x + alpha)
    s = total(up)
    return F.transform(up, lambda x: x / s)


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def entropy(v: Column | str, base: float = 2.0) -> Column:
    s = F.aggregate(c(v), F.lit(0.0), lambda a, x: a - xlogx(x))
    return s if base == 2.718281828459045 else s / F.ln(F.lit(float(base)))


def jsd_e(a: Column | str, b: Column | str) -> Column:
    """Jensen-Shannon divergence in nats; 0 log 0 = 0."""
    parts = F.zip_with(c(a), c(b), lambda x, y: 0.5 * (xlogx(x) + xlogx(y)) - xlogx((x + y) / 2))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def jsd_2(a: Column | str, b: Column | str) -> Column:
    return jsd_e(a, b) / F.lit(LN2)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def argmax(v: Column | str) -> Column:
    """Index from 0 of the first largest."""
    return (F.array_position(c(v), F.array_max(c(v))) - 1).cast("int")


def zero_one(a: Column | str, b: Column | str) -> Column:
    return F.when(argmax(a) == argmax(b), 0.0).otherwise(1.0)


def change_amount(prev: Column | str, cur: Column | str) -> Column:
    return F.aggregate(F.zip_with(c(cur), c(prev), lambda x, y: F.greatest(x - y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def change_direction(prev: Column | str, cur: Column | str) -> Column:
    """Where the positive change goes; uniform if there is none; null if either is missing."""
    up, s, n = F.zip_with(c(cur), c(prev), lambda x, y: F.greatest(x - y, F.lit(0.0))), change_amount(prev, cur), F.size(c(cur))
    return F.when(c(prev).isNotNull() & c(cur).isNotNull(), F.transform(up, lambda x: F.when(s == 0, 1.0 / n).otherwise(x / s)))


def change_magnitude(prev: Column | str, cur: Column | str) -> Column:
    """The positive change as a share of the most that was possible; 1 if either vector is missing."""
    return F.when(c(prev).isNull() | c(cur).isNull(), 1.0).otherwise(F.coalesce(F.try_divide(change_amount(prev, cur), 1 - F.least(F.array_min(c(prev)), F.lit(1.0))), F.lit(0.0)))


def additive_log_ratio(v: Column | str, tiny: float = 1e-7) -> Column:
    """Log ratios to the last component; zeros are replaced by tiny * (z + 1)(d - z) / d**2, the others scaled down."""
    d, z = F.size(c(v)), F.size(F.filter(c(v), lambda x: x == 0))
    r = F.lit(tiny) * (z + 1) * (d - z) / (d * d)
    fixed = F.transform(c(v), lambda x: F.when(x == 0, r).otherwise(x * (1 - z * r)))
    return F.transform(F.slice(fixed, 1, d - 1), lambda x: F.ln(x / F.element_at(fixed, -1)))


def soft_threshold(x: Column, level: Column | float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - level, F.lit(0.0))


def transition_distance(a: Column | str, b: Column | str) -> Column:
    """Mean over rows of the square root of the rows' JSD (base 2); a, b are array<array<double>>."""
    rows = F.zip_with(c(a), c(b), lambda x, y: F.sqrt(F.greatest(jsd_2(x, y), F.lit(0.0))))
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x) / F.size(c(a))


def focus_level(v: Column | str) -> Column:
    """How much of the mass the top tenth of the components (one at least) holds, 0 if spread evenly."""
    k = F.greatest(F.lit(1), F.floor(F.size(c(v)) / 10).cast("int"))
    return (total(F.slice(F.sort_array(c(v), asc=False), F.lit(1), k)) - 0.1) / 0.9


def perplexity(log_likelihood: Column, n: Column) -> Column:
    return F.exp(-log_likelihood / n)


def bic(log_likelihood: Column, parameters: Column | int, n: Column) -> Column:
    return -2 * log_likelihood + parameters * F.ln(n)


def log_sum_exp(v: Column | str) -> Column:
    m = F.array_max(c(v))
    return m + F.ln(F.aggregate(c(v), F.lit(0.0), lambda s, x: s + F.exp(x - m)))


def present(v: Column | str) -> Column:
    """Indexes of the steps that are not null."""
    return F.filter(F.transform(c(v), lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())


def cumulative(v: Column | str) -> Column:
    return F.transform(c(v), lambda x, i: total(F.slice(c(v), F.lit(1), i + 1)))


def select_topics(v: Column | str, prior: Column | str, least: float) -> Column:
    """The components whose prior reaches ``least``, as (topic, p), made to add up to 1 again: topics of noise go."""
    kept = F.filter(F.transform(c(v), lambda x, i: F.struct(i.cast("int").alias("topic"), x.alias("p"), F.get(c(prior), i).alias("q"))), lambda s: s["q"] >= least)
    s = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["p"])
    return F.transform(kept, lambda x: F.struct(x["topic"].alias("topic"), F.when(s == 0, x["p"]).otherwise(x["p"] / s).alias("p")))


def differs(v: Column | str, prior: Column | str, least: float = 1e-14) -> Column:
    """Whether a distribution says more than its prior."""
    return jsd_2(v, prior) >= least


def live_components(series: Column | str, tiny: float = 1e-7) -> Column:
    """Indexes of the components that are not 0 (up to ``tiny``) at every step of an array of vectors."""
    first = F.get(c(series), F.lit(0))
    return F.filter(F.transform(first, lambda x, i: i.cast("int")), lambda i: F.exists(c(series), lambda v: F.abs(F.get(v, i)) > tiny))


def centred(series: Column | str) -> Column:
    """Each component of an array of vectors less its mean over the steps."""
    n = F.size(c(series))
    mean = F.transform(F.get(c(series), F.lit(0)), lambda x, i: F.aggregate(c(series), F.lit(0.0), lambda a, v: a + F.get(v, i)) / n)
    return F.transform(c(series), lambda v: F.zip_with(v, mean, lambda x, m: x - m))


def side_by_side(a: Column | str, b: Column | str) -> Column:
    """Two series of equal length as one of longer vectors."""
    return F.zip_with(c(a), c(b), lambda x, y: F.concat(x, y))


def transpose(series: Column | str) -> Column:
    """Steps by components turned into components by steps."""
    return F.transform(F.get(c(series), F.lit(0)), lambda x, i: F.transform(c(series), lambda v: F.get(v, i)))


def kth_permutation(k: Column, n: int) -> Column:
    """The k-th (from 0) of the permutations of 0 .. n - 1 in lexical order, by the digits of k in factorial base."""
    rest, out, left = k, [], F.array(*[F.lit(i) for i in range(n)])
    size = 1
    for i in range(2, n):
        size *= i
    for i in range(n - 1, -1, -1):
        at = F.floor(rest / size).cast("int") if i else F.lit(0)
        out.append(F.get(left, at))
        left = F.concat(F.slice(left, F.lit(1), at), F.slice(left, at + 2, F.lit(n)))
        rest = rest % size
        size = size // i if i else 1
    return F.array(*out)


def gaussian(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-F.pow((x - mean) / sd, 2) / 2) / (sd * F.sqrt(F.lit(2 * 3.141592653589793)))


def log_normal(x: Column, mean: Column, sd: Column) -> Column:
    """Density at x > 0 of a value whose logarithm is normal."""
    return gaussian(F.ln(x), mean, sd) / x


def level_bounds(mean: Column, sd: Column, density: Column) -> Column:
    """Where a Gaussian passes a density: the two places as an array, empty if its peak is lower."""
    half = sd * F.sqrt(-2 * F.ln(density * sd * F.sqrt(F.lit(2 * 3.141592653589793))))
    return F.when(density * sd * F.sqrt(F.lit(2 * 3.141592653589793)) <= 1, F.array(mean - half, mean + half)).otherwise(F.array().cast("array<double>"))


def hmm_parameters(states: Column) -> Column:
    return states * states + 2 * states - 1


def art_parameters(pairs: Column, topics: Column, words: Column) -> Column:
    return pairs * (topics - 1) + topics * (words - 1)


def social_parameters(pairs: Column, states: Column, topics: Column, words: Column) -> Column:
    return states * pairs * (topics + states - 2) + topics * (words - 1)
