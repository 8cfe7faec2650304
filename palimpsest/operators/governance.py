"""Policy filters and predicates: tools, addresses, URLs, roles, message shapes."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Networks that must never be reached.
DENIED_NETS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
    "::/128", "::1/128", "64:ff9b::/96", "100::/64", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8",
)
#: What a policy may say about hosts, the first where it says nothing.
DEFAULT_BLOCK, ALLOWLIST_ONLY = "DEFAULT_BLOCK", "ALLOWLIST_ONLY"


def tool_allowed(tool: Column, allowed: Column, blocked: Column, deny_all: str = "__deny_all__") -> Column:
    """The sentinel denies all; blocking wins; a list of allowed tools that is not empty is exclusive."""
    a, b = F.coalesce(allowed, F.array().cast("array<string>")), F.coalesce(blocked, F.array().cast("array<string>"))
    return ~F.array_contains(b, deny_all) & ~F.array_contains(b, tool) & ((F.size(a) == 0) | F.array_contains(a, tool))


def prune(tools: Column, allowed: Column, blocked: Column) -> Column:
    """A catalogue without the tools that are not allowed."""
    return F.filter(tools, lambda t: tool_allowed(t, allowed, blocked))


_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def ipv4(address: Column) -> Column:
    """An IPv4 address, also one mapped into IPv6, as a number; null where it is none."""
    a = F.regexp_replace(F.lower(address), "^(?:0{1,4}:){5}ffff:|^::ffff:", "")
    p = F.split(a, r"\.")
    return F.when(a.rlike(f"^{_V4}$"), sum((F.get(p, k).cast("long") * (1 << 8 * (3 - k)) for k in range(1, 4)), F.get(p, 0).cast("long") * (1 << 24)))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def ipv6(address: Column) -> Column:
    """An IPv6 address as 32 hex digits; null where it is none. A zone after ``%`` is left out."""
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def without_tail(a: Column) -> Column:
        """An IPv4 address at the end as two groups."""
        tail = F.regexp_extract(a, f"^[0-9a-f:]*:({_V4})$", 1)
        hexed = F.lower(F.lpad(F.conv(ipv4(tail).cast("string"), 10, 16), 8, "0"))
        return F.when(tail != "", F.concat(F.substring(a, F.lit(1), F.length(a) - F.length(tail)), F.substring(hexed, 1, 4), F.lit(":"), F.substring(hexed, 5, 4))).otherwise(a)

    def digits(a: Column) -> Column:
        short = F.instr(a, "::") > 0
        sides = F.struct(groups(F.when(short, F.substring_index(a, "::", 1)).otherwise(a)).alias("l"), groups(F.when(short, F.substr(a, F.instr(a, "::") + 2)).otherwise(F.lit(""))).alias("r"))
        return _let(sides, lambda x: whole(x, F.size(x["l"]) + F.size(x["r"]), short))

    def whole(x: Column, n: Column, short: Column) -> Column:
        every = F.concat(x["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), x["r"])
        ok = F.when(short, n <= 7).otherwise(n == 8)
        return F.when(ok & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.upper(F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")))

    plain = F.lower(F.regexp_replace(address, "%[^%]+$", ""))
    return F.when(address.contains(":"), _let(_let(plain, without_tail), digits))


def denied_address(address: Column, nets: tuple[str, ...] = DENIED_NETS) -> Column:
    """In a denied network, or no address at all (which fails closed)."""

    def inside(x: Column) -> Column:
        out = x["n"].isNull() & x["h"].isNull()
        for net in map(ipaddress.ip_network, nets):
            low, high = int(net.network_address), int(net.broadcast_address)
            within = x["n"].between(low, high) if net.version == 4 else x["n"].isNull() & x["h"].between(f"{low:032X}", f"{high:032X}")
            out = out | F.coalesce(within, F.lit(False))
        return out

    return _let(F.struct(ipv4(address).alias("n"), ipv6(address).alias("h")), inside)


def in_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """addresses(ip, ...) joined with networks(net, low, high), ranges of any bounds, that hold them. A range is cut at the prefix
    length of its own size, so that it touches two prefixes at most; those are met by an equi-join, and then the bounds decide."""
    bits = (32 - F.ceil(F.log2(F.col("high") - F.col("low") + 1))).cast("int")
    lengths = [r["bits"] for r in networks.where("high >= low").select(bits.alias("bits")).distinct().orderBy("bits").limit(33).collect()]
    if not lengths:
        lengths = [0]
    n = addresses.withColumn("n", ipv4(F.col("ip")))
    prefixes = n.withColumn("bits", F.explode(F.array(*[F.lit(b) for b in lengths]))).withColumn("prefix", F.expr("shiftright(n, 32 - bits)"))
    nets = networks.where("high >= low").withColumn("bits", bits).withColumn("prefix", F.explode(F.expr("sequence(shiftright(low, 32 - bits), shiftright(high, 32 - bits))")))
    return prefixes.join(nets, ["bits", "prefix"]).where("n between low and high").drop("bits", "prefix", "n")


def host(url: Column) -> Column:
    """The host in lower case, without user, port and the dot at its end, an IPv6 one in brackets; null for anything that is not
    plainly http(s), which fails closed. Tabs and line breaks inside a URL are not part of it."""
    u = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    authority = F.regexp_extract(u, r"(?i)^https?://([^/\\?#]+)(?:[/?#]|$)", 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d{1,5}$", ""))
    plain = name.rlike(r"^(?:[a-z0-9_-]+\.)*[a-z0-9_-]+\.?$") | (name.rlike(r"^\[.*\]$") & ipv6(F.regexp_replace(name, r"[\[\]]", "")).isNotNull())
    return F.when(~u.contains("\\") & plain, F.regexp_replace(name, r"\.$", ""))


def glob_regex(glob: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r".+()[]{}^$|\\" else c for c in glob) + "$"


def egress_mode(mode: Column) -> Column:
    """A policy's mode: the default where it says nothing, allow-list only where it says something unknown."""
    m = F.upper(F.trim(mode))
    return F.when(mode.isNull(), DEFAULT_BLOCK).when(m.isin(DEFAULT_BLOCK, ALLOWLIST_ONLY), m).otherwise(ALLOWLIST_ONLY)


def egress_verdict(url: Column, mode: Column, domains: tuple[str, ...], addresses: Column) -> Column:
    """First reason that refuses a URL, or ``allow``. addresses: all that its host resolves to; a host that is an address is its
    own. One denied address is enough, and a host without any is refused."""
    h = host(url)
    listed = F.lit(False)
    for g in domains:
        listed = listed | h.rlike(glob_regex(g.lower()))
    literal = F.regexp_replace(h, r"[\[\]]", "")
    own = F.when(ipv4(literal).isNotNull() | ipv6(literal).isNotNull(), F.array(literal)).otherwise(addresses)
    refused = F.when(h.isNull(), "bad_url").when((egress_mode(mode) == ALLOWLIST_ONLY) & ~listed, "not_listed")
    return refused.when(F.coalesce(F.size(own) < 1, F.lit(True)), "no_address").when(F.exists(own, lambda x: denied_address(x)), "denied_address").otherwise("allow")


#: A scheme in any letters and what may follow it: any separators, as lenient parsers read ``http:h`` and ``http:\\\\h`` like ``http://h``,
#: then what an authority can begin with. ``host`` refuses all that is not canonical, so such a URL is found and refused.
URL = r"(?i)https?:(?=[\\/]*[\p{L}\p{N}\[%@:])[^\s\"'<>]+"
#: A bare number behind the scheme, in prose: below 2**24 it is no address that is reached, and not taken for a URL.
PORT_IN_PROSE = r"(?i)^https?:([1-9][0-9]{0,7})[).,;:!?\]]*$"


def find_urls(text: Column) -> Column:
    """Distinct URLs in a text, also with JSON's escaped slashes. Brackets and stops that end a sentence after a URL stay out of it."""
    found = F.regexp_extract_all(F.replace(text, F.lit("\\/"), F.lit("/")), F.lit(URL), F.lit(0))
    prose = lambda u: F.coalesce(F.regexp_extract(u, PORT_IN_PROSE, 1).try_cast("long") < 1 << 24, F.lit(False))
    kept = F.filter(found, lambda u: ~(u.rlike(PORT_IN_PROSE) & prose(u)))
    trimmed = lambda u: F.when(u.contains("["), F.regexp_replace(u, r"[)}.,;!?]+$", "")).otherwise(F.regexp_replace(u, r"[)\]}.,;!?]+$", ""))
    return F.array_distinct(F.transform(kept, trimmed))


def introduced(before: Column, after: Column) -> Column:
    """URLs that were not there before."""
    return F.array_except(find_urls(after), find_urls(before))


def resource_allowed(path: Column, globs: tuple[str, ...]) -> Column:
    """Decoded up to four times; refused with dot-dot steps, encoded separators left, or control characters."""
    from palimpsest.functions.text import percent_decode

    p = path
    for _ in range(4):
        p = percent_decode(p)
    ok = F.lit(False)
    for g in globs:
        ok = ok | p.rlike(glob_regex(g))
    return ok & ~p.rlike(r"(?:^|/)\.\.(?:/|$)|%2[fF]|%5[cC]|[\x00-\x1f]")


def collapse_roles(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """Runs of one role become one message. System turns are hoisted: their texts, in order, are the column ``system`` of every
    message of the conversation; one of system turns alone has no message."""
    in_order = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n")
    w = W.partitionBy(conversation).orderBy(order)
    rest = turns.where("role <> 'system'").withColumn("_new", (F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True))).cast("int"))
    rest = rest.withColumn("block", F.sum("_new").over(w))
    system = turns.where("role = 'system'").groupBy(conversation).agg(in_order().alias("system"))
    blocks = rest.groupBy(conversation, "block").agg(F.first("role").alias("role"), F.count(F.lit(1)).alias("n_turns"), in_order().alias("text"))
    return blocks.join(system, conversation, "left")


def user_first(blocks: DataFrame, conversation: str = "conv_id", opening: str = "Hello") -> DataFrame:
    """Messages of ``collapse_roles`` as a provider takes them whose conversations begin with the user: where another role begins,
    an ``opening`` of the user comes before it, as block 0. Roles other than user and assistant count as the user's."""
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    named = blocks.withColumn("role", role)
    lone = named.where("block = 1 and role = 'assistant'")
    first = lone.withColumn("block", F.lit(0).cast(named.schema["block"].dataType)).withColumn("role", F.lit("user")).withColumn("n_turns", F.lit(0).cast(named.schema["n_turns"].dataType)).withColumn("text", F.lit(opening))
    return named.unionByName(first)


def role_of_key(keys: DataFrame, roles: DataFrame, default: str | None) -> DataFrame:
    """keys(key_id) with their role; without one the default, without that the key fails closed."""
    return keys.join(roles, "key_id", "left").withColumn("role", F.coalesce("role", F.lit(default), F.lit("FAIL_CLOSED")))


def provider_of(header: Column, model: Column, upstream_host: Column, default: str) -> Column:
    """An explicit header decides; else the model's name, but only on the way to the one vendor's own host; else the default. A
    model's name says what is wanted, not who receives it."""
    h = F.regexp_replace(F.lower(F.trim(upstream_host)), r"\.+$", "")
    m = F.lower(model)
    # The vendor's host and how its models are named.
    there = (h == "anthropic.com") | h.endswith(".anthropic.com")
    named = m.contains("claude") | m.startswith("anthropic/")
    return F.when(F.length(header) > 0, F.lower(header)).when(F.coalesce(there & named, F.lit(False)), "anthropic").otherwise(default.lower())
