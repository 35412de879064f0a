"""Question tables of several makers as one: options, answers, series, contexts. A row that cannot be converted gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Section names of discussions.
SECTION = r"(?im)^\.(?:SYNOPSIS|DISCUSSION|NEAR TERM|SHORT TERM|LONG TERM)\b"
STOPS = "AVIATION|MARINE|FIRE WEATHER|HYDROLOGY|CLIMATE|PRELIMINARY POINT TEMPS/POPS|[A-Z]{2,3} WATCHES/WARNINGS/ADVISORIES"
#: How sensor questions are told apart, and their tables' titles.
ACTIVITY, SENSORS = "each timestamp containing X, Y, and Z values", "nine measurements (following the order)"
ACTIVITY_TITLE = ("Accelerometer observations at successive times (20 Hz).", "Observation | X | Y | Z")
SENSOR_TITLE = ("Sensor measurements (mg), not a sequence of nine times:", "Location | Horizontal forward | Vertical | Horizontal lateral")
PLACES = ("Ankle (lower leg)", "Thigh (above the knee)", "Hip")


def discussion(raw: Column, least: int = 80, most: int = 12_000) -> Column:
    """From the first wanted section to a stop section, marks removed, white space collapsed; null under `least` words."""
    text = F.translate(F.translate(raw, "\r", "\n"), "\0", " ")
    text = F.regexp_extract(text, rf"(?s)({SECTION}.*)$", 1)
    text = F.regexp_replace(text, rf"(?is)(?:^|(?<=\n))[ \t]*\.{{1,3}}(?:{STOPS})\b.*$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?m)^Issued at .*?$", ""), r"(?m)^&&\s*$", "")
    text = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), rf"(?i)\.{{1,3}}(?:{STOPS})\.{{2,3}}.*$", "")
    text = F.trim(text)
    return F.when(F.size(F.split(text, " ")) >= least, F.left(text, F.lit(most)))


def meaning(text: Column) -> Column:
    """A text with articles and two word forms made alike."""
    text = F.replace(F.lower(text), F.lit("this time series"), F.lit("the time series"))
    text = F.replace(F.replace(text, F.lit("increasing"), F.lit("increased")), F.lit("decreasing"), F.lit("decreased"))
    return F.trim(F.regexp_replace(text, r"\b(?:a|an)\s+", ""))


def lettered_options(prompt: Column, letters: str = "a-c", after: str = r"\) ", before: str = r"\(") -> Column:
    """(label, text) of the lines '(a) text' of a prompt."""
    lines = F.regexp_extract_all(prompt, F.lit(rf"(?m)^({before}[{letters}]{after}.+)$"), 1)
    pattern = rf"^{before}([{letters}]){after}(.+)$"
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("label"), F.regexp_extract(x, pattern, 2).alias("text")))


def answered(options: Column, label: Column) -> Column:
    """The labelled option, if no other option has its meaning; else null."""
    chosen = F.get(F.filter(options, lambda o: o["label"] == label), F.lit(0))
    same = F.filter(options, lambda o: meaning(o["text"]) == meaning(chosen["text"]))
    return F.when(F.size(same) == 1, F.get(same, F.lit(0)))


def four_options(options: Column) -> Column:
    """The options, if they are four different ones whatever their case; else null."""
    texts = F.transform(options, lambda o: F.lower(F.trim(o["text"])))
    return F.when((F.size(options) == 4) & (F.size(F.array_distinct(texts)) == 4), options)


def explained(text: Column) -> Column:
    """The one letter that an explanation names as the correct answer; else null."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)the correct answer is ([A-D])\."), 1)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def template_answer(text: Column) -> Column:
    """np.float64(x) as x."""
    return F.regexp_replace(text, r"np\.float64\(([-+\d.eE]+)\)", "$1")


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def sensor_table(values: Column, question: Column, texts: Column) -> Column:
    """Thirty values as ten rows of X, Y, Z, or nine as three places by three axes, as the question says; else null. `texts`: the values as text."""
    row = lambda i: F.array_join(F.slice(texts, 3 * i + 1, F.lit(3)), " | ")
    ten = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda t: F.concat(t.cast("string"), F.lit(" | "), row(t)))
    three = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda t: F.concat(F.get(F.array(*map(F.lit, PLACES)), t), F.lit(" | "), row(t)))
    lines = lambda title, rows: F.concat(F.lit("\n".join(title) + "\n"), F.array_join(rows, "\n"))
    return F.when(F.contains(question, F.lit(ACTIVITY)) & (F.size(values) == 30), lines(ACTIVITY_TITLE, ten)).when(F.contains(question, F.lit(SENSORS)) & (F.size(values) == 9), lines(SENSOR_TITLE, three))


def answer_kind(correct: Column) -> Column:
    """periods, spikes or rest, by the text of the correct option."""
    return F.when(F.contains(correct, F.lit("period length")), "periods").when(F.startswith(correct, F.lit("Spikes occur at")), "spikes").otherwise("rest")


def quantile(v: Column, level: Column) -> Column:
    """Quantile of an array, on the line between the two nearest order statistics."""
    s, at = F.array_sort(v), (F.size(v) - 1) * level
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(v) - 1))
    return a + (b - a) * (at - low)


def bounds(history: Column, mode: Column, u1: Column, u2: Column) -> tuple[Column, Column]:
    """Lower and upper limit of a future from quantiles of its history at u1 and u2 in [0.1, 0.9]: mode lower, upper or both."""
    a, b = quantile(history, u1), quantile(history, u2)
    lower = F.when(mode == "lower", a).when(mode == "both", F.least(a, b))
    upper = F.when(mode == "upper", a).when(mode == "both", F.greatest(a, b))
    return lower, upper


def bounds_context(lower: Column, upper: Column) -> Column:
    """The limits (as text) as a sentence."""
    limits = F.concat_ws(" and ", F.concat(F.lit("a minimum of "), lower), F.concat(F.lit("a maximum of "), upper))
    return F.concat(
        F.lit("Starting at the first requested future timestamp, the reported series will have "), limits,
        F.lit(". Values outside these limits are replaced by the nearest limit; values within them are unchanged. These limits apply throughout the requested future period, not to the historical observations."),
    )


def support_context(limits: Column) -> Column:
    """The upper bound of each step of a window, from an array of (t, text)."""
    lines = F.transform(limits, lambda x: F.concat(F.lit("("), x["t"].cast("string"), F.lit(", "), x["text"], F.lit(")")))
    return F.concat(F.lit("X_t in (0, b_t)\nb_t (upper support; time index, value):\n"), F.array_join(lines, "\n"))
