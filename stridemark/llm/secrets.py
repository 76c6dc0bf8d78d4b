"""Secret scans: candidates by pattern, false positives removed by a random forest.

All that touches documents is DataFrame and SQL functions: candidates, features and the trained
forest, which becomes one expression. Only training, on a few thousand labelled findings that
this module makes, runs on the driver.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import forest
from .common import table

RUN = r"A-Za-z0-9+/_\-"
SPACE = r"\x20\x09-\x0D"


def _anywhere(words: list[str], glues: list[str]) -> str:
    """A look-behind for any word, in any case, and glue; words of one length share one, as its width has to be fixed."""
    cased = lambda w: "".join(f"[{x.lower()}{x.upper()}]" if x.isalpha() else "[_\\-]" for x in w)
    widths = sorted({len(w) for w in words})
    return "|".join(f"(?<=(?:{'|'.join(cased(w) for w in words if len(w) == n)}){g})" for n in widths for g in glues)


#: Ends of names whose assigned values are candidates of any length and alphabet.
ENDS = ["pwd", "_key", "token", "secret", "passwd", "apikey", "password", "passphrase", "credential", "credentials"]
_BARE = _anywhere(ENDS, ["[=:]", "[=:] ", " [=:] ", "[\"']: ", "[\"']:"])
_QUOTED = _anywhere(ENDS, ["[=:][\"']", "[=:] [\"']", " [=:] [\"']", "[\"']:[\"']", "[\"']: [\"']"])
#: A candidate is the value of a named assignment, what stands between a colon and the at sign of a host, or else a
#: whole run of at least 16 of RUN with a digit in it, with dotted parts of such runs and trailing padding. The same
#: text is a pattern of Java and of Python.
CANDIDATE = (
    rf"(?<=[=:])(?:{_BARE})[^{SPACE}\"'`&]++"
    rf"|(?<=[=:] )(?:{_BARE})[^{SPACE}\"'`&]++"
    rf"|(?:(?<=[=:][\"'])|(?<=[=:] [\"']))(?:{_QUOTED})(?:(?<=\")[^\"\r\n]++|(?<=')[^'\r\n]++)"
    rf"|(?<=[A-Za-z0-9_]:)[^{SPACE}\"'`@/:]++(?=@[A-Za-z0-9])"
    rf"|(?<![{RUN}])(?=[A-Za-z+/_\-]*+[0-9])[{RUN}]{{16,}}+(?:\.[{RUN}]{{16,}}+)*+(?:={{1,2}}(?![{RUN}=]))?"
)
#: Characters before and after a candidate that its features see.
CONTEXT, AFTER = 40, 24
MARK = "[SECRET]"
#: Words of identifiers and paths, for the dictionary coverage.
DICTIONARY = (
    "access account address admin article asset backup bench blog branch bucket build cache camera card category change chapter "
    "class client cloud code comment commit config connect content copy count customer data date default detail device digest "
    "document domain download draft email entry error event example export feature file final folder format forum frame function "
    "gallery group guide handler header history home host html http https icon image import index info input install invoice issue "
    "item journal json label language latest layout library license line link list local locale login mail main manual master media "
    "message method model module month name network news node note number object option order output owner package page part path "
    "patch payment photo picture plan player plugin point policy post price print process product profile project public query record "
    "release report request resource response result review revision root route sample schema screen script search section serial "
    "server service session setting shop site source spec stack staging start state static status store story style subject summary "
    "support survey system table task team template test text theme thread thumb ticket time title topic tracking train type update "
    "upload user value version video view volume web week widget window work world year"
).split()
NAMED = r"(?:secret|token|passw|pwd|api.?key|apikey|access.?key|private.?key|auth|bearer|credential|client.?key|signing)"
HARMLESS = r"(?:example|sample|dummy|fake|placeholder|sha.?1|sha.?256|sha.?512|md5|checksum|commit|digest|hash|uuid|guid|etag|integrity|revision|isbn|phone|order|invoice|version|build|serial|blob|tree|id)"

#: The user's name in a URL, up to the colon.
USERINFO = r"://[^\s/@:]{0,30}:$"
FEATURES = ["length", "changes", "digits", "uppers", "kinds", "hexadecimal", "coverage", "vowels", "slashes", "path", "url", "named", "harmless", "assigned", "quoted", "uuid", "userinfo", "host after", "file after", "harmless after"]


#: Features of the text after: pattern of each.
FOLLOWED = {
    "host after": r"^@[a-z0-9]",
    "file after": r"^[/\\]|^\.[a-z]{2,4}(?![a-z0-9])",
    "harmless after": r"^[^a-z]{0,4}(?:is )?(?:an? )?(?:example|sample|dummy|fake|placeholder|checksum|digest|commit|hash|revision|required|optional)(?![a-z])",
}


def features(c: Column, before: Column, after: Column) -> Column:
    """The features of a candidate, the text before it and the text after it, as a struct of doubles."""
    low, near, then = F.lower(c), F.lower(F.substring(before, -CONTEXT, CONTEXT)), F.lower(F.substring(after, 1, AFTER))
    n = F.length(c)
    classes = c
    for pattern, to in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^a-zA-Z0-9]+", "-")):
        classes = F.regexp_replace(classes, pattern, to)
    words = F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    has = lambda text, pattern: F.when(text.rlike(pattern), 1.0).otherwise(0.0)
    values = {
        "length": n,
        "changes": (F.length(classes) - 1) / n,
        "digits": count(c, "[0-9]") / n,
        "uppers": count(c, "[A-Z]") / n,
        "kinds": has(c, "[a-z]") + has(c, "[A-Z]") + has(c, "[0-9]") + has(c, "[^a-zA-Z0-9]"),
        "hexadecimal": has(c, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "coverage": F.lit(1.0) - words / n,
        "vowels": count(low, "[aeiou]") / n,
        "slashes": count(c, "/") / n,
        "path": has(near, r"[/\\.]$"),
        "url": has(near, r"[a-z]{2,6}://\S*$"),
        "named": has(near, NAMED + r"[^a-z]{0,12}(?:[a-z]{1,10}[^a-z]{1,6}){0,2}$"),
        "harmless": has(near, r"(?<![a-z])" + HARMLESS + r"[^a-z]{0,12}(?:[a-z]{1,10}[^a-z]{1,6}){0,2}$"),
        "assigned": has(near, r"""[:=]>?\s*["'`]?$"""),
        "quoted": has(near, r"""["'`]$"""),
        "uuid": has(low, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "userinfo": has(near, USERINFO),
        **{f: has(then, pattern) for f, pattern in FOLLOWED.items()},
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def feature_row(c: str, before: str, after: str) -> list[float]:
    """The same features for one finding, for training and tests."""
    low, near, n, then = c.lower(), before[-CONTEXT:].lower(), len(c), after[:AFTER].lower()
    classes = c
    for pattern, to in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^a-zA-Z0-9]+", "-")):
        classes = re.sub(pattern, to, classes)
    words = re.sub("|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "", low)
    count = lambda text, pattern: len(re.findall(pattern, text, re.ASCII))
    has = lambda text, pattern: float(bool(re.search(pattern.replace("$", r"\Z"), text, re.ASCII)))
    return [
        float(n), (len(classes) - 1) / n, count(c, "[0-9]") / n, count(c, "[A-Z]") / n,
        has(c, "[a-z]") + has(c, "[A-Z]") + has(c, "[0-9]") + has(c, "[^a-zA-Z0-9]"),
        has(c, "^(?:[0-9a-f]+|[0-9A-F]+)$"), 1.0 - len(words) / n, count(low, "[aeiou]") / n, count(c, "/") / n,
        has(near, r"[/\\.]$"), has(near, r"[a-z]{2,6}://\S*$"), has(near, NAMED + r"[^a-z]{0,12}(?:[a-z]{1,10}[^a-z]{1,6}){0,2}$"),
        has(near, r"(?<![a-z])" + HARMLESS + r"[^a-z]{0,12}(?:[a-z]{1,10}[^a-z]{1,6}){0,2}$"), has(near, r"""[:=]>?\s*["'`]?$"""),
        has(near, r"""["'`]$"""), has(low, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        has(near, USERINFO), *(has(then, pattern) for pattern in FOLLOWED.values()),
    ]


def findings(n: int = 3000, seed: int = 10) -> list[tuple[str, str, str, int]]:
    """Labelled findings (text before, candidate, text after, 1 for a secret): the candidates of whole lines made by rule from a seed."""
    r = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    word = lambda: r.choice(DICTIONARY) if r.random() < 0.4 else some(lower, r.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 8)))
    hexa = lambda k: some("0123456789abcdef", k)
    names = ["token", "secret", "api_key", "apiKey", "access_key", "password", "auth_token", "client_secret", "private_key", "credential", "signing_key", "Bearer", "bot_token", "passwd"]
    plain = ["sha1", "sha256", "md5", "checksum", "commit", "digest", "hash", "uuid", "etag", "revision", "order", "invoice", "version", "build", "serial", "blob", "example", "sample", "id"]
    glue = lambda: r.choice([" = ", "=", ": ", ":", ' = "', '="', ': "', " = '", "='", '": "', " ", " is "])
    out = []
    for _ in range(n):
        secret = r.random() < 0.5
        if secret:
            kind = r.randrange(11)
            value = [
                lambda: hexa(r.choice([32, 40, 40, 40, 48, 64])),
                lambda: some(lower + upper + digit, r.randint(20, 48)),
                lambda: "AKIA" + some(upper + digit, 16),
                lambda: r.choice(["ghp_", "sk-", "xoxb-", "glpat-", "pk_live_"]) + some(lower + upper + digit, r.randint(20, 40)),
                lambda: some(lower + upper + digit + "+/", r.choice([40, 43, 64])) + r.choice(["", "="]),
                lambda: some(lower + upper + digit + "_-", r.randint(18, 60)),
                lambda: some(lower, r.randint(2, 6)) + some(upper + digit + "!@$.%^*#", r.randint(3, 8)),
                lambda: some(lower + upper, r.randint(12, 30)),
                lambda: "eyJ" + ".".join(some(lower + upper + digit + "_-", k) for k in (r.randint(17, 40), r.randint(20, 90), 43)),
                lambda: r.choice([some(lower + upper + digit + "!$%^*-_.", r.randint(5, 20)), word() + some(digit, r.randint(1, 4)) + some(lower, r.randint(0, 4))]),
                lambda: r.choice([word(), word() + word()]) + r.choice("!@#$%^&*.-_ ").strip() + some(digit, r.randint(1, 4)) + r.choice(["", word(), some("!?*#", 1)]),
            ][kind]()
            # the forms with a mark of their own are secrets wherever they stand
            named = r.random() < (0.6 if kind in (2, 3) else 1.0)
            site = f"https://{word()}.com/{word()}?" if r.random() < 0.1 else " "
            before = prose() + site + (r.choice(names) + glue() if named else r.choice(["", glue(), word() + " "]))
            after = r.choice(["", "\n", " " + prose(), "; " + prose(), ", " + prose()])
            if kind == 9:
                before = prose() + r.choice([" ", "=", '"']) + r.choice(["postgres", "mysql", "mongodb", "amqp", "redis", "https", "ftp"]) + f"://{r.choice([word(), ''])}:"
                after = f"@{word()}" + r.choice([".com", "", ":5432"]) + "/" + word()
        else:
            kind = r.randrange(12)
            value = [
                lambda: hexa(r.choice([32, 40, 40, 64])),
                lambda: "-".join(hexa(k) for k in (8, 4, 4, 4, 12)),
                lambda: "/".join([word() for _ in range(r.randint(2, 5))] + [some(digit, r.randint(1, 6))]),
                lambda: some(digit, r.randint(16, 22)),
                lambda: r.choice("-_").join([word() for _ in range(r.randint(2, 6))] + [some(digit, r.randint(1, 8))]),
                lambda: "".join(word() for _ in range(r.randint(2, 5))) + some(digit, r.randint(1, 4)),
                lambda: r.choice(["=", "-", "_"]) * r.randint(8, 30) + some(digit, r.randint(8, 10)),
                lambda: some(lower + upper + digit, r.randint(20, 40)),
                lambda: "-".join(some(digit, k) for k in (4, 2, 2)) + "-" + some(digit, r.randint(6, 12)),
                lambda: r.choice([word(), word(), r.choice(["true", "false", "null", "None", "***", "xxxx", "string", "required"])]),
                lambda: r.choice(["${" + word().upper() + "}", "<" + word() + ">", word() + "." + word() + "()", word() + "_" + word(), word() + "."]),
                lambda: word() + r.choice(["", ".", "-", "+"]) + word(),
            ][kind]()
            near = r.choice([r.choice(plain) + glue(), r.choice(plain) + " ", "https://" + word() + ".com/", word() + "/", ""]) if kind in (0, 7) else r.choice(["", word() + " ", r.choice(plain) + glue(), "https://" + word() + ".org/", word() + "/", word() + glue()])
            if kind in (9, 10):
                near = r.choice(names) + glue()
            before = prose() + " " + near
            after = r.choice(["", "\n", " " + prose(), f".{r.choice(['png', 'html', 'py', 'jpg'])} ", "/" + word(), f" {r.choice(plain)} ", f" is an example {prose()}"])
            if kind == 11:
                before, after = prose() + r.choice([" mailto:", " cc:", " contact:", " from:", f" https://{word()}.com/{word()}:"]), f"@{word()}.com {prose()}"
        if r.random() < 0.1:
            before, value = before.upper(), value.upper()
        line, at = before + value + after, 0
        held = list(re.finditer(CANDIDATE, line))
        for m, then in zip(held, [*held[1:], None], strict=False):
            if m.end() > len(before) and m.start() < len(before + value):
                out.append((line[at : m.start()], m[0], line[m.end() : then and then.start()], int(secret)))
            at = m.end()
    return out


@lru_cache(maxsize=2)
def trained(n: int = 3000, seed: int = 10) -> list[forest.Node]:
    rows = findings(n, seed)
    return forest.train(np.array([feature_row(c, b, a) for b, c, a, _ in rows]), np.array([y for *_, y in rows]), seed=seed)


def scan(df: DataFrame, text: str = "text", into: str = "secret_scan") -> DataFrame:
    """``df`` with one more column, ``into``: struct(pieces, findings).

    findings holds each candidate of the whole text in order, as (value, probability, secret);
    pieces the text before, between and after them. A null text is one null piece without
    findings, an empty one an empty piece. No shuffle; rows and other columns stay as they are, so
    a column named ``into`` is an error.
    """
    if into in df.columns:
        raise ValueError(f"there already is a column {into}")
    model = forest.to_sql(trained(), [f"r.f.`{name}`" for name in FEATURES])
    t, own = F.col(f"`{text}`"), F.col(f"`{into}`")
    values = F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))
    pieces = F.split(t, CANDIDATE, -1)
    # the pattern is tried first, so that the rest runs on few texts
    found = F.when(t.rlike(CANDIDATE), F.struct(pieces.alias("pieces"), values.alias("values")))
    found = F.coalesce(found, F.struct(F.array(t).alias("pieces"), F.array().cast("array<string>").alias("values")))
    out = df.withColumn(into, found)
    piece = lambda i: F.get(own["pieces"], i)
    rated = F.transform(own["values"], lambda c, i: F.struct(c.alias("value"), features(c, piece(i), piece(i + 1)).alias("f")))
    out = out.withColumn(into, F.struct(own["pieces"].alias("pieces"), rated.alias("rated")))
    judged = F.expr(f"transform(`{into}`.rated, r -> named_struct('value', r.value, 'probability', {model}))")
    judged = F.transform(judged, lambda r: F.struct(r["value"].alias("value"), r["probability"].alias("probability"), (r["probability"] >= 0.5).alias("secret")))
    return out.withColumn(into, F.struct(own["pieces"].alias("pieces"), judged.alias("findings")))


def redacted(mark: str = MARK, scanned: str = "secret_scan") -> Column:
    """The text of a scanned row with every secret replaced by ``mark``; null for null."""
    f, p = F.col(f"`{scanned}`")["findings"], F.col(f"`{scanned}`")["pieces"]
    shown = F.transform(f, lambda r: F.when(r["secret"], F.lit(mark)).otherwise(r["value"]))
    joined = F.array_join(F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.get(shown, i), F.lit("")))), "")
    return F.when(F.get(p, F.lit(0)).isNotNull(), joined)


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    f = F.col("secret_scan.findings")
    secrets = F.filter(f, lambda r: r["secret"])
    return found.select(
        "doc_id", F.size(f).alias("n_candidates"), F.size(secrets).alias("n_secrets"),
        F.transform(secrets, lambda r: F.sha2(r["value"], 256)).alias("secret_sha256s"),
        F.sha2(F.coalesce(redacted(), F.lit("")), 256).alias("redacted_sha256"),
    )
