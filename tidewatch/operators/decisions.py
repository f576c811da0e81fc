"""Campaigns in words, and what a decision layer says of them (SC21-SC28, AG29, MX7-MX9, Q19): texts, offline rules in place of a service, probabilities and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of classes in texts. Fixed values.
IPID = {"ip54321": "always 54321", "ip0": "always zero", "ipconst": "constant", "ipinc": "incrementing", "iprand": "random", "ip1": "unknown (one sample)", "na": "unknown"}
SPORT = {"spfix": "fixed", "spnarrow": "confined to a narrow fixed range", "spinc": "incrementing", "sprand": "random", "sp1": "unknown (one sample)"}
STRATEGY = {"seq_fwd": "sequential, increasing addresses", "seq_rev": "sequential, decreasing addresses", "uperm": "uniform random permutation", "perm": "non-uniform permutation", "undet": "undetermined (too few samples)"}
OPTIONS = {"N": "NOP", "S": "SACK-permitted", "T": "timestamps", "E": "end-of-list"}
#: Well-known ports. Fixed values.
PORTS = {
    21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 81: "HTTP-alt", 110: "POP3", 123: "NTP", 135: "MS-RPC", 137: "NetBIOS", 139: "NetBIOS-SSN", 143: "IMAP", 161: "SNMP", 389: "LDAP", 443: "HTTPS", 445: "SMB", 500: "IKE", 554: "RTSP", 1433: "MSSQL",
    1723: "PPTP", 1900: "SSDP", 2323: "Telnet-alt", 3306: "MySQL", 3389: "RDP", 5060: "SIP", 5555: "Android ADB", 5900: "VNC", 6379: "Redis", 7547: "TR-069", 8080: "HTTP-alt", 8443: "HTTPS-alt", 8888: "HTTP-alt", 9200: "Elasticsearch", 11211: "Memcached", 27017: "MongoDB", 37215: "Huawei HG532", 52869: "UPnP",
}
TOOLS = ("Mirai-family", "ZMap", "Masscan", "Research scanner", "Unknown")
SEVERITIES = ("can wait", "this week", "today", "right now")


def named(c: Column, names: dict) -> Column:
    """The name of a value; the value itself where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)]), c), c.cast("string"))


def options_text(o: Column) -> Column:
    """SC23: an option signature in words."""
    word = lambda t: F.when(t.startswith("M"), F.concat(F.lit("MSS="), F.substring(t, 2, 9))).when(t.startswith("W"), F.concat(F.lit("window-scale="), F.substring(t, 2, 9))).otherwise(named(t, OPTIONS))
    return F.when(F.coalesce(o, F.lit("")).isin("", "-", "nan"), "none").otherwise(F.array_join(F.transform(F.split(o, r"\."), word), ", "))


def ports_text(sig: Column) -> Column:
    """SC23: a port signature in words."""
    number = lambda x: x.try_cast("int")
    known = F.create_map(*[F.lit(x) for k, v in PORTS.items() for x in (k, v)])
    parts = F.filter(F.split(F.regexp_replace(sig, "^p+", ""), r"\+"), lambda x: number(x).isNotNull())
    text = F.array_join(F.transform(parts, lambda x: F.when(F.try_element_at(known, number(x)).isNotNull(), F.concat(x, F.lit(" ("), F.try_element_at(known, number(x)), F.lit(")"))).otherwise(x)), ", ")
    return F.when(sig.isin("multi", "pmulti"), "many ports (port sweep)").when(text == "", sig).otherwise(text)


def ascii_text(hexed: Column) -> Column:
    """SC22: bytes in hexadecimal as printable characters, others as dots; empty for what isn't hexadecimal."""
    ok = hexed.rlike("^([0-9a-fA-F]{2})*$")
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.length(hexed) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(~ok | (hexed == ""), "").otherwise(F.array_join(F.transform(codes, lambda c: F.when(c.between(32, 126), F.chr(c)).otherwise(".")), ""))


def short_fingerprint(fpc: Column) -> Column:
    """SC27: a core fingerprint in a few words."""
    f = F.split(fpc, r"\|")
    has = lambda x: F.array_contains(f, x)
    win, ttl = F.get(F.filter(f, lambda x: x.startswith("w")), 0), F.get(F.filter(F.slice(f, 2, 99), lambda x: x.rlike("^t[0-9]+$")), 0)
    tags = F.array_compact(F.array(F.when(has("sD"), "seq=dst"), F.when(has("i54321"), "IPID 54321"), F.when(~win.isin("wx", "w"), F.concat(F.lit("win "), F.substring(win, 2, 9))), F.when(has("o-"), "no opts"), F.when(ttl.isNotNull(), F.concat(F.lit("TTL "), F.substring(ttl, 2, 9)))))
    head = F.regexp_replace(ascii_text(F.substring(F.get(f, 4), 3, 99)), r"^\.+|\.+$", "")
    return F.when(F.get(f, 0) == "udp", F.when(head != "", F.concat(F.lit("UDP, payload '"), F.substring(head, 1, 6), F.lit("'"))).otherwise("UDP")).otherwise(F.array_join(F.slice(tags, 1, 3), ", "))


def tool_label(fpc: Column, research: Column) -> Column:
    """PRJ2: the tool that a core fingerprint speaks for."""
    f = F.split(fpc, r"\|")
    has = lambda x: F.array_contains(f, x)
    return F.when(has("sD"), "Mirai-family").when(has("i54321"), "ZMap").when(has("w1024") & has("o-"), "Masscan").when(research >= 0.5, "Research scanner").otherwise("Unknown")


def described(sig: DataFrame) -> DataFrame:
    """SC24: inference.signature() with ``state``, the campaign in words: fingerprint and behaviour, no labels."""
    fp = F.get("top_fp", 0)["value"]
    f = F.split(fp, r"\|")
    at = lambda i, n=1: F.substring(F.get(f, i), n + 1, 99)
    strategies = F.array_join(F.transform("top_strategy", lambda x: F.concat(named(x["value"], STRATEGY), F.lit(" ("), F.format_string("%.0f", x["share"] * 100), F.lit("%)"))), ", ")
    proto = F.upper(F.get(f, 0))
    win = at(3)
    tcp = F.concat(F.lit("Shared packet-header fingerprint: initial IP TTL "), at(1), F.lit("; IP ID "), named(F.get(f, 2), IPID), F.lit("; TCP window "), F.when(win.isin("", "x"), "random").otherwise(win), F.lit("; TCP options "), options_text(at(4)), F.lit("; TCP sequence number "),
                   F.when(at(5) == "D", "equal to the destination IP address").when(at(5) == "Z", "zero").otherwise("random-looking"), F.lit("; source port "), named(F.get(f, 6), SPORT), F.lit("; DF bit "), at(7, 2), F.lit("."))
    udp = F.concat(F.lit("Shared packet-header fingerprint: initial IP TTL "), at(1), F.lit("; IP ID "), named(F.get(f, 2), IPID), F.lit("; source port "), named(F.get(f, 3), SPORT), F.lit("; DF bit "), at(4, 2), F.lit("; payload begins with bytes "), F.col("phead"), F.lit(' (hex), ASCII "'), ascii_text(F.col("phead")), F.lit('".'))
    lines = F.array_compact(F.array(
        F.format_string("A group of %d source IP addresses observed by a passive network telescope (unused address space) during the measurement window.", F.col("bots")),
        F.concat(F.lit("Transport: "), F.when(proto == "TCP", "TCP SYN").otherwise(proto), F.lit(". Destination port(s): "), ports_text(F.col("portsig")), F.lit(".")), F.when((proto == "TCP") & (F.size(f) >= 8), tcp).when((proto == "UDP") & (F.size(f) >= 6), udp),
        F.concat(F.lit("Target-selection strategy (statistical tests on sampled destinations): "), strategies, F.lit(".")),
        F.format_string("Destinations are %s; median rate at the telescope %.1f packets per hour per source; %d distinct dark destinations in total.", F.get("top_disp", 0)["value"], F.col("pph_med"), F.col("ud_sum")),
        F.format_string("Sources span %d countries and %d autonomous systems.", F.col("n_cc"), F.col("n_asn")),
    ))
    return sig.withColumn("state", F.array_join(lines, "\n"))


def activity_text(share: Column, hours: int) -> Column:
    """MX20: a campaign's share of active members in each hour, in words. share: an array."""
    return F.concat(F.lit(f"Fraction of these sources active in each hour of the day (hours 0-{hours - 1}): "), F.array_join(F.transform(share, lambda x: F.format_string("%.2f", x)), ", "), F.lit("."))


def rule_service(state: str) -> dict:
    """An offline stand-in for a decision service: the public scanner fingerprints as rules over a state's text."""
    tool = "Mirai-family" if "equal to the destination IP" in state else "ZMap" if "always 54321" in state else "Masscan" if "TCP window 1024" in state and "options none" in state else "Unknown"
    sequential = "sequential" in state
    severity = {"Mirai-family": 3, "Masscan": 2, "ZMap": 1}.get(tool, 1 + sequential)
    rest = 0.2 / (len(TOOLS) - 1)
    spread = [0.1, 0.1, 0.1, 0.1]
    spread[severity] = 0.7
    return {"answers": {
        "tool": {"type": "choice", "probabilities": {str(i): 0.8 if t == tool else rest for i, t in enumerate(TOOLS)}, "legend": {str(i): t for i, t in enumerate(TOOLS)}}, "coordinated": {"type": "noul", "noul": 0.8 if tool == "Mirai-family" else 0.3},
        "severity": {"type": "score", "probabilities": dict(zip(SEVERITIES, spread, strict=True))},
    }}


ANSWER = "answers MAP<STRING, STRUCT<type: STRING, noul: DOUBLE, probabilities: MAP<STRING, DOUBLE>, legend: MAP<STRING, STRING>>>"


def probabilities(answer: Column, question: str) -> Column:
    """SC25: the probabilities of a question's options from an answer's JSON text: yes and no, or the options by their legend; an empty map without any."""
    a = F.from_json(answer, ANSWER)["answers"][question]
    none = F.create_map().cast("map<string,double>")
    named_ = F.transform_keys(a["probabilities"], lambda k, v: F.coalesce(F.try_element_at(a["legend"], k), k))
    yes = F.when(a["noul"].isNotNull(), F.map_from_arrays(F.array(F.lit("yes"), F.lit("no")), F.array(a["noul"], 1 - a["noul"])))
    return F.coalesce(F.when(a["type"] == "noul", yes).otherwise(named_), none)


def best(p: Column) -> Column:
    """SC26: (k, p), the option of most probability, the first by name of several."""
    top = F.array_sort(F.transform(F.map_entries(p), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("k"))))
    return F.struct(F.get(top, 0)["k"].alias("k"), (-F.get(top, 0)["m"]).alias("p"))


def with_rest(p: Column, k: int = 4, least: float = 0.005) -> Column:
    """MX7: the k likeliest options, and what is left as ``rest`` where it is ``least`` or more: array of (option, p)."""
    top = F.transform(F.array_sort(F.transform(F.map_entries(p), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("k")))), lambda x: F.struct(x["k"].alias("option"), (-x["m"]).alias("p")))
    left = F.aggregate(F.slice(top, k + 1, 999), F.lit(0.0), lambda t, x: t + x["p"])
    return F.concat(F.slice(top, 1, k), F.when(left >= least, F.array(F.struct(F.lit("rest").alias("option"), left.alias("p")))).otherwise(F.filter(top, lambda x: F.lit(False))))


def normalised(p: Column, options: tuple[str, ...] = SEVERITIES) -> Column:
    """SC28: probabilities of known options, by lower-case name, scaled to a sum of 1; null where they have none."""
    keys = F.transform_keys(p, lambda k, v: F.lower(F.trim(k)))
    raw = F.array(*[F.greatest(F.coalesce(F.try_element_at(keys, F.lit(o)), F.lit(0.0)), F.lit(0.0)) for o in options])
    total = F.aggregate(raw, F.lit(0.0), lambda t, x: t + x)
    return F.when(total > 0, F.transform(raw, lambda x: x / total))


def severity(p: Column) -> Column:
    """SC28, MX9: (expectation, level, likeliest) of the severity's probabilities."""
    s = normalised(p)
    mean = F.aggregate(F.transform(s, lambda x, i: x * i), F.lit(0.0), lambda t, x: t + x)
    return F.when(s.isNotNull(), F.struct(mean.alias("expectation"), F.floor(mean + 0.5).cast("int").alias("level"), (F.array_position(s, F.array_max(s)) - 1).cast("int").alias("likeliest")))


def majority(members: DataFrame) -> DataFrame:
    """AG29: (camp, strategy) of members(camp, strategy): the most frequent strategy of those determined, undet without any."""
    g = members.groupBy("camp").agg(F.expr("mode(strategy, true) FILTER (WHERE strategy <> 'undet')").alias("strategy"))
    return g.withColumn("strategy", F.coalesce("strategy", F.lit("undet")))


def judged(rows: DataFrame) -> DataFrame:
    """Q19: one row: how often the answers name the right tool, and the likeliest strategy the right one. rows: (tool, told_tool, strategy, told_strategy, seconds)."""
    return rows.agg(F.count("*").alias("campaigns"), F.avg((F.col("tool") == F.col("told_tool")).cast("double")).alias("tool_acc"), F.avg((F.col("strategy") == F.col("told_strategy")).cast("double")).alias("strategy_acc"), F.median("seconds").alias("latency_median"))
