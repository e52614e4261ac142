"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Everything that touches documents is DataFrame expressions. Base spans follow fixed formats and always stay. Further
generators propose wide spans (numbers, secrets, passwords, written-out addresses); features of format and context go
through boosted trees that are written as one SQL expression. The trees are fitted on a bounded set of labelled
sentences made from forms, so they do not depend on the corpus; thresholds are calibrated on forms not fitted on.
Positions and overlaps come from scans by doubling (round k looks 2**k elements back), so a text costs n log n in the
number of its spans.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed; the first four are the base formats.
BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "secret", "password", "address")
#: Stand for a dot between domain characters and for a separator between digits; the texts' own are replaced before.
DOT, JOIN, OTHER = "\x01", "\x02", "\x03"
DOMAIN, LOCAL = "A-Za-z0-9-", "A-Za-z0-9._%+" + DOT + "-"
_AT, _DOT = (rf"(?: ?[(\[{{<] ?(?i:{w}) ?[)\]}}>] ?| (?i:{w}) )" for w in ("at", "dot"))
PATTERNS = {
    # Equal to the stated formats, without nested repetition: no backtracking over long runs and no deep recursion.
    "email": f"(?:(?<![{LOCAL}])|\\G)[{LOCAL}]++@[{DOMAIN}]++{DOT}[A-Za-z0-9{DOT}-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": f"[0-9][0-9{JOIN}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![A-Za-z0-9.])[(]?[0-9][0-9 ().-]{6,}+",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+",
    # After an assignment anything, after a blank alone what holds a digit.
    "password": r"""(?i)(?<![A-Za-z0-9!#-&*+./?@^_~-])(?=[A-Za-z0-9!#-&*+./?@^_~-]{6})(?:(?<=(?:pass|word|wd|phrase|secret|key|token|code|pin)["']{0,1} {0,1}(?:[:=]|is) {0,1}["']{0,1})|(?<=(?:pass|word|wd|phrase|secret|key|token|code|pin) ["']{0,1})(?=[A-Za-z!#-&*+./?@^_~-]*+[0-9]))[A-Za-z0-9!#-&*+./?@^_~-]++""",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _AT + "[A-Za-z0-9-]++(?:(?:" + _DOT + r"|\.)[A-Za-z0-9-]++){1,8}+",
}
#: A text needs a match of this before the pattern itself is tried; every match of the pattern holds one.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "number": "[0-9][0-9 ().-]{6}", "secret": "[0-9]", "password": r"(?i)(?:pass|word|wd|phrase|secret|key|token|code|pin)(?:[\"']? ?(?:[:=]|is)| [\"']?[A-Za-z!#-&*+./?@^_~-]*+[0-9])", "address": r"(?i)[ (\[{<]at[ )\]}>]"}
#: Code points of context; of a block of text in ``redact``.
CONTEXT, BLOCK = 40, 4096
CUES = {
    "about_phone": r"(?i)\b(?:phone|tel|telephone|call|called|mobile|mob|cell|fax|sms|text|whatsapp|contact|ring|rang|dial|hotline|reach|number)\b",
    "about_account": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|account|acct|iban|ssn|social security|passport|tax id|national id|licen[cs]e no|routing|sort code|member(?:ship)?|customer|client|patient|policy|employee|subscriber|beneficiary)\b",
    "about_secret": r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|\bkey\b|auth|bearer|credential)",
    "about_hash": r"(?i)(?:\b(?:commit|checksum|digest|hash|revision|rev|blob|tree|etag|uuid|guid|fingerprint|object|request|trace|session)\b|sha-?[0-9]|md5|/)",
    "about_other": r"(?i)\b(?:version|build|isbn|issn|order|invoice|pages?|years?|sku|part|figure|lines?|items?|price|total|score|from|between|ticket|issue|section|lot|serial|id|ids|values?|population|since|until|dated?)\b",
    "about_mail": r"(?i)\b(?:e-?mail|mail|write|reach|contact|address|me|us|send|ask)\b",
    "assigned": r"""(?:[:=]|=>|\bis) ?["'`]?$""",
    "quoted": r"""["'`]$""",
}
FORMAT = ("length", "digits", "upper", "lower", "separators", "spaces", "dots", "groups", "first_group", "last_group", "turns", "distinct", "vowels", "hexadecimal", "uuid", "prefixed", "date", "zero", "brackets", "luhn", "inside", "identifier", "camel", "marks")
FEATURES = (*(f"is_{k}" for k in ADDED), *FORMAT, *CUES)
#: Public prefixes of access keys.
PREFIXED = r"^(?:gh[pousr]_|github_pat_|glpat-|AKIA|ASIA|AIza|sk[-_]|pk[-_]|rk[-_]|xox[abprs]-|npm_|eyJ|ya29)"
DATE = r"^(?:[12][0-9]{3}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ][0-9]{4}|[12][0-9]{3} ?- ?[12][0-9]{3})(?:[ .-].*)?$"
#: Names as code has them: words, abbreviations and short numbers joined by signs, or by capitals; of so many code points
#: at most (these patterns repeat groups, which recurses).
NAME = 128
IDENTIFIER = "^[/_-]*(?:[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[A-Z][a-z]+|[0-9]{1,4}[a-z]{0,4}|[a-z]+[0-9][a-z]{1,8})(?:[/_-]+(?:[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[A-Z][a-z]+|[0-9]{1,4}[a-z]{0,4}|[a-z]+[0-9][a-z]{1,8}))+[/_-]*$"
CAMEL = "^[A-Za-z]?[a-z]+(?:[0-9]{0,3}[A-Z][a-z]+)+[0-9]{0,4}$"
#: Forms of labelled sentences, by kind: 1 are to be redacted, 0 are not. '#' a digit, '9' one of 1-9, '~' a hexadecimal
#: digit, '?' a lower-case letter, '^' an upper-case letter, '*' a letter or digit. '|' parts alternatives, {word} draws from WORDS.
WORDS = {
    "phone": "call|phone:|tel|my mobile|fax|ring|dial|text me on|reach us at|contact|sms|the number is|hotline|whatsapp",
    "account": "ssn|account no|card number|passport|social security|tax id|national id|acct|sort code|iban|credit card|membership|policy no|employee|client|subscriber",
    "bare": "password|passphrase|my password|the password|secret|pwd|wifi password",
    "secret": "password|api key|api_key|secret|access_key|auth token|client_secret|private key|bearer|credential|passphrase|secret key",
    "set": " = | = '|: |=|: '| is |=\"| ",
    "hash": "commit|sha1|md5|checksum|digest|hash|revision|blob|etag|fingerprint|object|sha256:|tree",
    "other": "order|version|build|invoice|pages|lines|items|total|score|ticket|issue|section|lot|serial|part|id|values|population",
    "plain": "the|and then|they saw|it was|a|with|of|we had|near|about|so|there were",
    "mail": "mail|write to|email|reach|contact|send it to|ask",
    "end": "today|please|.|,| soon|and| now|'|\"|;|) |",
}
FORMS = (
    (1, "{phone} (9##) ###-####"), (1, "{phone} 9##-###-####"), (1, "{phone} 9##.###.####"), (1, "{phone} 9## ### ####"), (1, "{phone} 0# ## ## ## ##"), (1, "{phone} 0### ######"),
    (1, "{phone} 9#########"), (1, "{phone} 0## ### ####"), (1, "{phone} 0###-#######"), (1, "{phone} 0##.##.##.##.##"), (1, "{phone} ###-####"), (1, "{phone} 0#### ######"),
    (1, "{phone} 0# ## ## ## ## 0# ## ## ## ##"), (1, "{phone} 9##-###-#### 9##-###-####"), (1, "{phone} 0## #### ####"), (1, "{phone} (0##) #### ####"), (1, "{phone} 1-9##-###-####"),
    (1, "{plain} (9##) ###-####"), (1, "{plain} 9##-###-####"), (1, "{plain} 9##.###.####"), (1, "{plain} 0# ## ## ## ##"), (1, "{plain} ###-##-####"), (1, "{plain} (0##) #### ####"), (1, "{plain} 0## #### ####"), (1, "{plain} 0#### ######"), (1, "{plain} 1-9##-###-####"),
    (1, "{account} ###-##-####"), (1, "{account} #########"), (1, "{account} ##########"), (1, "{account} #### ###### #####"), (1, "{account} ## #### #### #### ####"), (1, "{account} ############"), (1, "{account} ### ### ###"), (1, "{account} ##-##-## ########"),
    *((1, "{secret}{set}" + x) for x in ("~" * 20, "~" * 32, "~" * 40, "~" * 64, "*" * 20, "*" * 24, "*" * 32, "*" * 40, "?#^?#^?#^?#^?#^?#", "^" * 4 + "#^" * 8, "*" * 22 + "==", "????-####-^^^^-*****")),
    *((1, "{plain} " + x) for x in ("ghp_" + "*" * 36, "AKIA" + "^#" * 8, "sk_live_" + "*" * 24, "xoxb-##########-" + "*" * 24, "AIza" + "*" * 35, "glpat-" + "*" * 20, "eyJ" + "*" * 40, "npm_" + "*" * 36)),
    *((1, "{secret}{set}" + x) for x in ("?????##", "^????##!", "??#?#??", "#??#^??#", "^??????#$", "????####", "?#?#?#?#?#", "^?????-##", "*********#")),
    *((1, "{bare} " + x) for x in ("?????##", "^????##!", "??#?#??", "#??#^??#", "^??????#$", "?#?#?#?#?#", "#########^", "?##^?##^?##^", "^?##!?##", "????####")),
    *((0, "{bare} " + x) for x in ("????_???????_v#", "????????_20##", "?????-????-##", "2###-0#-1#", "v#.##.#", "section#", "????_##", "?????_???????_????_##")), *((0, "{secret}{set}" + x) for x in ("???_?????_???_#", "?????_?????_v##_????????")),
    *((0, "{plain} " + x) for x in ("???_????_??_????_#_?#", "????_???_????_##_??????", "?????#_????##?_?????_####_?", "??????-????-????-####-?????", "^^^^_^^^^_^^^^_####_^^", "^^^_^^^^^^_####", "?????^?????^??????#", "????^????????^?????##", "?????#^??????^???????^????", "?????^???????^?????#^??????", "????_#???_??????_???_#", "__????_????__#_????", "??#?????_????_????_#", "^????^???????^????####", "^^_^^^^^_##_^^^^^^^", "????-?????-????????-?#-?????", "/????/????_####/?????_??")),
    *((1, "{mail} " + x) for x in ("????? (at) ????? (dot) com", "????.??? [at] ?????? [dot] org", "?????? at ????? dot net", "????## (at) ????? dot com", "?.????? AT ??????? DOT com", "???? {at} ?????? {dot} io", "??????(at)?????.com", "???? at ????? dot co dot uk", "??_???? <at> ????? <dot> edu")),
    *((1, "{plain} " + x) for x in ("????? (at) ????? (dot) com", "???? [at] ?????? [dot] org", "??????[at]?????.com", "???.???? at ??????? dot com", "???? {at} ?????? {dot} io")),
    *((0, "{hash} " + x) for x in ("~" * 7 + "~" * 33, "~" * 32, "~" * 64, "~" * 20, "~" * 16)), *((0, "{plain} " + x) for x in ("~" * 40, "~" * 32, "~" * 64)),
    *((0, "{plain} " + x) for x in ("~~~~~~~~-~~~~-~~~~-~~~~-~~~~~~~~~~~~", "?????????????????#", "????-?????-?????-####-????", "?????/??????/????##/???????", "?????_??????_##_???????", "????-####-##-##-??????", "??????????????????????##", "/???/????/??????#/?????")),
    *((0, "{hash} " + x) for x in ("~~~~~~~~-~~~~-~~~~-~~~~-~~~~~~~~~~~~", "????-~~~~~~~~~~~~~~~~")), (0, "{other} ~~~~~~~~-~~~~-~~~~-~~~~-~~~~~~~~~~~~"), (0, "{plain} ?????.~~~~~~~~~~~~~~~~~~~~.js"), (0, "{plain} ?????-~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~.css"),
    *((0, "{other} " + x) for x in ("9#########", "9.##.####.#", "####-####", "######## ", "#### #### ####", "####.## ####.##", "######-######", "##-####-##", "###-#-##-######-#", "### - ### - ###", "#######", "9######.##", "######## ########")),
    *((0, "{plain} " + x) for x in ("9#########", "2###-0#-1#", "1#/0#/19##", "19##-20##", "####### #######", "9######.####", "#### #### ####", "1#.0#.20##", "20##-1#-2# 1#.##.##", "0.########", "########", "9## ### ###", "1## 2## 3## 4##", "##.###### ##.######", "9 ### ### ###", "2###.###.##", "20######", "#### - ####")),
    *((0, "{secret}{set}" + x) for x in ("required", "changeme", "????????", "None,", "string;", "?????????", "os.environ", "???.????()", "length", "<?????>", "${???????}", "???????????????")), *((0, "{plain} " + x) for x in ("?????? at ???? dot ????", "???? at ???????.com", "???? at ????.??????", "????? at the ???.")), (0, "looked at the dot on maps"), (0, "at ????? dot plots show"), (0, "he was at ?????? dot ???? again"), (0, "{other} at ????? dot ????"),
)
#: Made sentences of each form; every fifth form of a label calibrates instead of fitting.
EXAMPLES, ROUNDS, RATE, PRECISION, HELD = 24, 60, 0.3, 0.97, 5


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, step) -> Column:
    """The running result of an associative ``step`` over an array, by doubling."""
    powers = lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(2)))).cast("int") - F.lit(1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    turn = lambda acc, back: F.transform(acc, lambda x, i: F.when(i >= back, step(x, F.get(acc, i - back))).otherwise(x))
    return let(values, lambda v: F.aggregate(powers(v), v, turn))


def spans_of(view: Column, kind: str) -> Column:
    """Structs start, end, body, before, next of the leftmost non-overlapping matches, in code points.

    before: up to CONTEXT code points before the match, next: the one after it.
    """
    # What stands between the matches, and the matches; the last has none.
    pairs = lambda m: F.zip_with(F.split(view, PATTERNS[kind], -1), m, lambda g, b: F.struct(g.alias("gap"), b.alias("body")))
    size = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["body"]), F.lit(0))

    def place(parts: Column) -> Column:
        ended = F.zip_with(parts, scan(F.transform(parts, size), lambda x, y: x + y), lambda p, e: F.struct(p["body"].alias("body"), p["gap"].alias("gap"), e.alias("end")))

        def one(x: Column, i: Column) -> Column:
            earlier = F.coalesce(F.get(parts, i - 1)["body"], F.lit(""))
            before, after = F.right(F.concat(earlier, x["gap"]), F.lit(CONTEXT)), F.left(F.get(parts, i + 1)["gap"], F.lit(1))
            return F.struct((x["end"] - F.length(x["body"])).alias("start"), x["end"].alias("end"), x["body"].alias("body"), before.alias("before"), after.alias("next"))

        return F.filter(F.transform(ended, one), lambda s: s["body"].isNotNull())

    none = F.array().cast("array<struct<start:int,end:int,body:string,before:string,next:string>>")
    matched = let(F.regexp_extract_all(view, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(pairs(m), place)).otherwise(none))
    return F.when(view.rlike(NEEDS[kind]), matched).otherwise(none)


def digits_of(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string holds."""
    value = lambda i: F.substring(digits, F.length(digits) - i + F.lit(1), F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))).otherwise(value(i))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + doubled(i))
    return (F.length(digits) > 0) & (total % 10 == 0)


def base_spans(text: Column) -> dict[str, Column]:
    """The four base formats, failing matches dropped."""
    dotted = F.regexp_replace(F.translate(text, DOT, OTHER), f"(?<=[{DOMAIN}])\\.(?=[{DOMAIN}])", DOT)
    joined = F.regexp_replace(F.translate(text, JOIN, OTHER), "(?<=[0-9])[ -](?=[0-9])", JOIN)
    part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
    n = lambda s: F.length(digits_of(s["body"]))
    gated = lambda needs, view, kind: F.when(needs, spans_of(view, kind)).otherwise(spans_of(F.lit(""), kind))
    return {
        "email": gated(text.contains("@"), dotted, "email"),
        "ip": F.filter(spans_of(text, "ip"), lambda s: F.forall(F.split(s["body"], r"\."), part)),
        "card": F.filter(F.filter(gated(text.rlike(NEEDS["card"]), joined, "card"), lambda s: s["end"] - s["start"] >= 16), lambda s: F.when(n(s).between(16, 19), luhn(digits_of(s["body"]))).otherwise(False)),
        "phone": F.filter(spans_of(text, "phone"), lambda s: n(s).between(8, 15)),
    }


def candidate_features(span: Column, kind: str) -> Column:
    """Format of the span and cues in the text before it."""
    body, before = span["body"], span["before"]
    count = lambda pattern: F.length(F.regexp_replace(body, f"[^{pattern}]", "")).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    runs = F.filter(F.split(body, "[^0-9A-Za-z]+"), lambda g: F.length(g) > 0)
    size = lambda g: F.coalesce(F.length(g), F.lit(0)).cast("double")
    digits = digits_of(body)
    values = {f"is_{k}": F.lit(float(k == kind)) for k in ADDED} | {
        "length": F.length(body).cast("double"), "digits": count("0-9"), "upper": count("A-Z"), "lower": count("a-z"), "separators": count(r" ().\[\]_/-"), "spaces": count(" "), "dots": count("."),
        "groups": F.size(runs).cast("double"), "first_group": size(F.get(runs, F.lit(0))), "last_group": size(F.get(runs, F.size(runs) - 1)),
        "turns": F.regexp_count(body, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]")).cast("double"), "distinct": F.size(F.array_distinct(F.split(F.left(body, F.lit(256)), ""))).cast("double"), "vowels": count("aeiou"),
        "hexadecimal": flag(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "uuid": flag(body.rlike("^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")), "prefixed": flag(body.rlike(PREFIXED)), "date": flag(body.rlike(DATE)),
        "zero": flag(body.rlike("^[(]?0")), "brackets": flag(body.rlike(r"[(\[{<]")), "luhn": flag(F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)), "inside": flag(span["next"].rlike("[A-Za-z0-9@_]")),
        "identifier": flag((F.length(body) <= NAME) & F.left(body, F.lit(NAME)).rlike(IDENTIFIER)), "camel": flag((F.length(body) <= NAME) & F.left(body, F.lit(NAME)).rlike(CAMEL)), "marks": count("!#$%&*+?@^~"),
    } | {k: flag(before.rlike(p)) for k, p in CUES.items()}
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), *(values[f].alias(f) for f in FEATURES))


def candidates(text: Column) -> Column:
    """Spans of all further generators, which may overlap, with their features."""

    def trimmed(kind: str, s: Column) -> Column:
        ends = {"number": " ().-", "password": "."}.get(kind)
        if ends is None:
            return s
        rest = F.rtrim(s["body"], F.lit(ends))
        cut = F.length(s["body"]) - F.length(rest)
        after = F.when(cut > 0, F.substring(s["body"], F.length(rest) + 1, F.lit(1))).otherwise(s["next"])
        return F.struct(s["start"].alias("start"), (s["end"] - cut).alias("end"), rest.alias("body"), s["before"].alias("before"), after.alias("next"))

    def one(kind: str) -> Column:
        spans = F.transform(spans_of(text, kind), lambda s: trimmed(kind, s))
        if kind == "number":
            spans = F.filter(spans, lambda s: F.length(digits_of(s["body"])) >= 7)
        return F.transform(spans, lambda s: candidate_features(s, kind))

    return F.concat(*map(one, ADDED))


def made_sentences(forms=FORMS, examples: int = EXAMPLES, seed: int = 1) -> list[tuple[int, int, str]]:
    """Form, label and text: each form with drawn words, digits and letters. At most forms x examples."""
    rng, marks = random.Random(seed), {"#": "0123456789", "9": "123456789", "~": "0123456789abcdef", "?": "abcdefghijklmnopqrstuvwxyz", "^": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "*": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
    out = []
    for k, (label, form) in enumerate(forms):
        for _ in range(examples):
            words = {w: rng.choice(choice.split("|")) for w, choice in WORDS.items()}
            text = re.sub("{(" + "|".join(WORDS) + ")}|(.)", lambda m, words=words: words[m[1]] if m[1] else rng.choice(marks.get(m[2], m[2])), form)
            out.append((k, label, f"{words['plain']} {text}{words['end']}"))
    return out


def labelled_rows(spark: SparkSession, sentences: list[tuple[int, int, str]]) -> DataFrame:
    """Candidates of made sentences with their labels."""
    listed = json.dumps([{"id": i, "form": k, "label": y, "text": t} for i, (k, y, t) in enumerate(sentences)])
    made = spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<struct<id:int,form:int,label:int,text:string>>")).alias("s")).select("s.*")
    rows = made.select("id", "form", "label", F.explode(candidates(F.col("text"))).alias("c"))
    return rows.select("id", "form", "label", "c.kind", "c.start", *(f"c.{f}" for f in FEATURES))


def _split(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray):
    """Best single cut of any feature: gain, feature, threshold."""
    best = (1e-6, None, None)
    whole = gradient.sum() ** 2 / (weight.sum() + 1)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(gradient[order]), np.cumsum(weight[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + 1) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1) - whole
            if gain.max() > best[0]:
                k = cut[gain.argmax()]
                best = (gain.max(), f, (v[k] + v[k + 1]) / 2)
    return best


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int):
    """A tree (feature, threshold, left, right) or a leaf value, by second-order boosting."""
    _, feature, threshold = _split(x, gradient, weight) if depth and len(x) else (0, None, None)
    if feature is None:
        return RATE * float(gradient.sum() / (weight.sum() + 1))
    low = x[:, feature] <= threshold
    return feature, float(threshold), _grow(x[low], gradient[low], weight[low], depth - 1), _grow(x[~low], gradient[~low], weight[~low], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = 3) -> list:
    """Boosted trees of the logistic loss."""
    trees, score = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, y - p, p * (1 - p), depth))
        score += _value(trees[-1], x)
    return trees


def tree_sql(tree, name: str) -> str:
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    return f"CASE WHEN {name}.{FEATURES[tree[0]]} <= {tree[1]:.4f}D THEN {tree_sql(tree[2], name)} ELSE {tree_sql(tree[3], name)} END"


def calibrate(kinds: np.ndarray, scores: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> dict[str, float]:
    """For each kind the least score from which on held-out spans reach the precision."""
    out = {}
    for kind in ADDED:
        own = kinds == kind
        order = np.argsort(-scores[own], kind="stable")
        s, right = scores[own][order], np.cumsum(y[own][order])
        last = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, bool)  # a threshold takes all of equal scores
        good = np.flatnonzero(last & (right >= precision * np.arange(1, len(s) + 1)) & (right > 0))
        k = good[-1] if len(good) else None
        out[kind] = float("inf") if k is None else float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 0.1)
    return out


def held_forms() -> set[int]:
    """Every HELD-th form of each label calibrates instead of fitting."""
    return {k for y in (0, 1) for i, k in enumerate(k for k, (label, _) in enumerate(FORMS) if label == y) if i % HELD == HELD - 1}


def train(spark: SparkSession) -> tuple[list, dict[str, float]]:
    """Trees, and the threshold of each kind, from made sentences only."""
    rows = labelled_rows(spark, made_sentences()).orderBy("id", "kind", "start").collect()  # of a fixed number of sentences
    x, y = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r["label"] for r in rows], float)
    held = np.isin([r["form"] for r in rows], list(held_forms()))
    trees = fit_trees(x[~held], y[~held])
    scores = sum(_value(t, x[held]) for t in trees)
    return trees, calibrate(np.array([r["kind"] for r in rows])[held], scores, y[held])


def find_pii(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` columns in ``keep``, the whole text (null: empty), and ``pii``: structs kind, start, end by kind, then start.

    Spans are in code points, end exclusive. Added spans may overlap others, but one inside another span is left out
    (of equal ones the kind listed first stays). Empty texts and tables have no spans; repeated rows count each; ids
    may be null; columns not in ``keep`` play no part.
    """
    trees, thresholds = train(docs.sparkSession)
    text = F.col("pii_text")
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("pii_text"))
    rows = rows.select("*", F.struct(*(c.alias(k) for k, c in base_spans(text).items())).alias("pii_base"), candidates(text).alias("pii_wide"))
    total = " + ".join(tree_sql(t, "c") for t in trees)
    bar = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {'double(\"Infinity\")' if v == float('inf') else f'{v:.6f}D'}" for k, v in thresholds.items()) + " END"
    rows = rows.withColumn("pii_scored", F.expr(f"filter(transform(pii_wide, c -> struct(c.kind AS kind, c.start AS start, c.`end` AS `end`, {total} AS score, {bar} AS bar)), s -> s.score >= s.bar)"))
    rank = F.create_map(*(x for i, k in enumerate(BASE + ADDED) for x in (F.lit(k), F.lit(i))))
    span = lambda s, kind: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), rank[kind].alias("rank"), kind.alias("kind"))
    of_base = lambda k: F.transform(F.col(f"pii_base.{k}"), lambda s: span(s, F.lit(k)))
    every = F.concat(*map(of_base, BASE), F.transform("pii_scored", lambda s: span(s, s["kind"])))
    rows = rows.withColumn("pii_every", F.array_sort(every))
    # Sorted by start, the longer first: a span lies inside another one if some earlier span ends as late.
    reach = scan(F.transform("pii_every", lambda s: -s["back"]), F.greatest)
    outer = lambda e: F.filter(F.transform("pii_every", lambda s, i: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end"), (s["rank"] >= len(BASE)).alias("added"), F.coalesce(F.get(e, i - 1) >= -s["back"], F.lit(False)).alias("inside"))), lambda s: s["added"] & ~s["inside"])
    none = F.array().cast("array<struct<kind:string,start:int,end:int,added:boolean,inside:boolean>>")
    rows = rows.withColumn("pii_added", F.when(F.size("pii_scored") > 0, let(reach, outer)).otherwise(none))
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = [named(F.col(f"pii_base.{k}"), k) for k in BASE] + [named(of_kind(F.col("pii_added"), k), k) for k in ADDED]
    return rows.select(*keep, text.alias("whole_text"), F.concat(*spans).alias("pii"))


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b of a text cut into blocks, so that no piece is searched for from the start."""
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
        inner = F.concat(F.substring(block(i), a - i * BLOCK + F.lit(1), F.lit(BLOCK)), F.array_join(F.slice(blocks, i + F.lit(2), F.greatest(j - i - 1, F.lit(0))), ""), F.substring(block(j), F.lit(1), b - j * BLOCK))
        return F.when(i == j, F.substring(block(i), a - i * BLOCK + F.lit(1), b - a)).otherwise(inner)

    def replaced(blocks: Column, own: Column, reach: Column) -> Column:
        heads = F.filter(F.transform(own, lambda s, i: F.struct(i.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"), F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("after"))), lambda s: (s["at"] == 0) | (s["after"] <= s["start"]))
        parts = F.transform(heads, lambda s: F.concat(piece(blocks, s["after"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        last = F.element_at(reach, -1)
        return F.concat(F.array_join(parts, ""), piece(blocks, last, F.greatest(last, F.length(text))))

    ends = lambda own: scan(F.transform(own, lambda s: -s["back"]), F.greatest)
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = let(ordered, lambda own: let(cut, lambda blocks: let(ends(own), lambda reach: replaced(blocks, own, reach))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
