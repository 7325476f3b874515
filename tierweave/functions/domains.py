"""Domain names: predicates and base domains, as column expressions.

All take and give string columns and stay in the JVM. What a registry's suffix is, the public-suffix list
says (``suffixes``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierweave.functions import fixed_values as V
from tierweave.functions import suffixes
from tierweave.functions.binding import let


def _last(labels: Column, n: int | Column) -> Column:
    """The last ``n`` labels as a name."""
    size = F.size(labels)
    return F.array_join(F.slice(labels, F.greatest(size - n + 1, F.lit(1)), size), ".")


def is_ip(c: Column) -> Column:
    """Every label is made of digits: an IPv4 address or a part of one."""
    return c.rlike(r"^[0-9]+(\.[0-9]+)*$")


def strip_technical_prefix(c: Column) -> Column:
    """Lower-cased, without the first technical prefix that fits."""
    return F.regexp_replace(F.lower(c), "^(?:" + "|".join(p.replace(".", r"\.") for p in V.TECHNICAL_PREFIXES) + ")", "")


def base_domain(c: Column) -> Column:
    """The registrable domain below a registry suffix; addresses whole, else the last two labels.

    Single labels and bare suffixes come back as they are. Null gives null.
    """
    cleaned = strip_technical_prefix(c)
    name = F.regexp_replace(F.trim(cleaned), r"\.+$", "")
    known = rf"^(?:{suffixes.pattern()}(?:[^.]*\.)?|[^.]*\.(?:[^.]*\.)?)"
    base = F.when(is_ip(name), name).otherwise(F.substring(F.reverse(F.regexp_extract(suffixes.backwards(name), known, 0)), 2, 1 << 20))
    return F.when(F.instr(name, ".") > 0, base).when((F.instr(cleaned, ".") > 0) & (name != ""), cleaned).otherwise(F.lower(c))


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\.+$", ""))


def registry_suffix(c: Column) -> Column:
    name = _plain(c)
    return F.when(~is_ip(name), F.nullif(suffixes.taken(name, ""), F.lit("")))


def registrable_label(c: Column) -> Column:
    """The label that a registrant chose; null for addresses and bare or unknown suffixes."""
    name = _plain(c)
    return F.when(~is_ip(name), F.nullif(F.trim(suffixes.below(name)), F.lit("")))


def lookup_base_domain(c: Column) -> Column:
    """The base domain by which known vendors are looked up: three labels below a few compound suffixes, else two."""
    return let(F.split(c, r"\."), lambda labels: F.when(F.size(labels) <= 2, c).otherwise(F.when(_last(labels, 2).isin(*V.LOOKUP_SUFFIXES), _last(labels, 3)).otherwise(_last(labels, 2))))


def last_two_labels(c: Column) -> Column:
    """The base domain by which the registry is looked up."""
    return _last(F.split(c, r"\."), 2)


def is_organizational(c: Column) -> Column:
    """The name is its own base domain."""
    return base_domain(c) == F.lower(F.regexp_replace(F.trim(c), r"\.+$", ""))


def in_list(c: Column, names: tuple[str, ...]) -> Column:
    """The name is one of ``names`` or below one: one anchored pattern, whatever the number of names."""
    return c.rlike(r"(?:^|\.)(?:" + "|".join(n.replace(".", r"\.") for n in names) + r")\z")


def is_common_infrastructure(c: Column) -> Column:
    return in_list(c, V.COMMON_INFRASTRUCTURE)


def is_marketing(c: Column) -> Column:
    return in_list(c, V.MARKETING)


def is_certificate_infrastructure(c: Column) -> Column:
    """By plain ending, without regard to label boundaries."""
    return c.rlike("(?:" + "|".join(n.replace(".", r"\.") for n in V.CERTIFICATE_INFRASTRUCTURE) + r")\z")


def is_ip_host(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"^\[+", ""), r"\]+$", "")
    return is_ip(bare) | bare.rlike(r"^(?=.*:.*:)[0-9A-Fa-f:.]+$")


def is_web_noise(c: Column) -> Column:
    return is_ip_host(c) | c.isin(*V.WEB_NOISE)


def is_social(c: Column) -> Column:
    return c.isin(*V.SOCIAL)


def is_dns_name(c: Column) -> Column:
    """Underscores may begin or fill a label; two labels at least."""
    return ~c.contains("..") & ~c.endswith(".") & c.rlike(V.DNS_NAME) & c.contains(".") & F.octet_length(c).between(4, 253)


def is_batch_domain(c: Column) -> Column:
    edge = c.rlike(r"^[.-]|[.-]$")
    return (c != "") & c.contains(".") & ~c.contains("://") & ~c.contains("/") & ~edge & ~c.contains("..") & c.rlike(r"^[A-Za-z0-9.-]+$")


def is_resolvable_name(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda x: x.startswith("_") | ~x.contains("_"))


def is_non_registrable(c: Column) -> Column:
    """Not a public host: empty, not a plain name, without a dot, or under no known suffix (private ones count as known)."""
    host = F.trim(c)
    return (host == "") | host.rlike(r"[/:?# \t@]") | ~host.contains(".") | ~suffixes.is_known(_plain(host))


def normalize_for_lookup(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^(?:_spf\.|_dmarc\.)", "")


def same_organization(vendor: Column, customer: Column) -> Column:
    """Equal base domains, or both in one group of known aliases."""
    alike = lambda v, c: (v == c) | reduce(lambda a, b: a | b, [v.isin(*g) & c.isin(*g) for g in V.SELF_ALIAS_GROUPS])
    return let(base_domain(vendor), lambda v: let(base_domain(customer), lambda c: alike(v, c)))


def host_of(url: Column) -> Column:
    """The host of an absolute URL."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)
