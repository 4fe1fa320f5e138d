"""URL, id and time functions as Catalyst expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second labels that make a public suffix together with a country's two letters (a rule in place of a list).
SECOND_LABELS = "ac co com ed edu go gob gouv gov gub lg mil ne net nhs nom or org plc police sch".split()


def host(url: Column) -> Column:
    """Lower-cased host without user, port; the scheme may be missing."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^.*@", ""), r":[0-9]*$", "")


def domain_of(url: Column) -> Column:
    """Registered domain (suffix and one label before it); addresses of numbers and single labels stay; nothing gives 'unknown'."""
    name = F.regexp_replace(host(url), r"\.+$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    ending = lambda k: F.array_join(F.slice(labels, F.greatest(n - (k - 1), F.lit(1)), F.lit(k)), ".")
    number = name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    two = F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.get(labels, n - 2).isin(SECOND_LABELS)
    return F.when(name == "", F.lit("unknown")).when(number, name).when(F.coalesce(two, F.lit(False)), ending(3)).otherwise(ending(2))


def site_of(url: Column) -> Column:
    """Host without a leading www. or m.: finer than domain_of where one domain holds many sites."""
    return F.when(host(url) == "", F.lit("unknown")).otherwise(F.regexp_replace(host(url), r"^(?:www|m)\.", ""))


def norm_url(url: Column) -> Column:
    """Lower case, without fragment, trailing slashes, scheme and www."""
    s = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)#.*$", ""), r"/+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^https://", ""), r"^http://", ""), r"^www\.", "")


def run_id(ts: Column, salt: Column, zone: str = "Europe/Helsinki") -> Column:
    """YYYY-MM-DDTHHMM-hex4 in the given zone."""
    return F.concat(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd'T'HHmm"), F.lit("-"), F.substring(F.sha2(salt.cast("string"), 256), 1, 4))


def layer_spec(spec: Column, layers: int) -> Column:
    """'all', 'full', or a list of numbers and ranges ('1,3-5'), clamped to 1..layers, sorted and distinct."""
    part = F.transform(F.split(spec, r"\s*,\s*"), lambda p: F.sequence(
        F.least(F.greatest(F.element_at(F.split(p, "-"), 1).try_cast("int"), F.lit(1)), F.lit(layers)),
        F.least(F.greatest(F.element_at(F.split(p, "-"), -1).try_cast("int"), F.lit(1)), F.lit(layers)),
    ))
    return F.when(spec == "all", F.sequence(F.lit(1), F.lit(layers))).when(spec == "full", F.array(F.lit(layers))).otherwise(F.array_sort(F.array_distinct(F.flatten(part))))
