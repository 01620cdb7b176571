"""What the detectors look for: patterns of linear-time engines, said for Java's engine and for RE2."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_WORD = "\\p{L}\\p{M}\\p{Nd}\\p{Pc}"
_BLANK = "\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}"


def java(pattern: str) -> str:
    """Unicode classes and case, and lines that end at a line feed alone.

    A value is what ends well and has a word character before that. Java backtracks, so there the first such
    character is passed without ways back; which stretch matches is the same.
    """
    return "(?dU)" + pattern.replace(_S, _S_JAVA)


def wrong(pattern: str) -> str | None:
    """What is wrong with a pattern for the engine that will run it, which is asked; without a session Python's is."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            re.compile(pattern)
        else:
            spark._jvm.java.util.regex.Pattern.compile(java(pattern))
    except re.error as error:
        return str(error)
    except (Py4JJavaError, PySparkException) as error:
        return str(error).splitlines()[0]
    return None


def re2(pattern: str) -> str:
    """The same for RE2, whose classes are ASCII and whose counts end at 1000."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in ("\\w", "\\s", "\\d"):
            body = {"\\w": _WORD, "\\s": _BLANK, "\\d": "\\p{Nd}"}[two]
            out.append(body if inside else f"[{body}]")
            i += 2
        elif two == "\\W":
            out.append(f"[^{_WORD}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            if pattern[i] == "[" and not inside:
                inside = True
                if pattern[i + 1 : i + 3] == "^]" or pattern[i + 1] == "]":
                    raise ValueError("escape ] in a class")
            elif pattern[i] == "]" and inside:
                inside = False
            out.append(pattern[i])
            i += 1
    return "".join(out).replace(",1024}", ",1000}")


def assignment(prefix: str, keyword: str, secret: str) -> str:
    """A pattern for ``prefix keyword = secret`` in the shapes that configuration and code give it. ValueError if it isn't one."""
    quote = "[\"']?"
    made = rf"(?i)(?:\W|^)\[?{quote}{prefix}[_-]?{keyword}{quote}\]? *(?::=|=>|::|:|=| +) *{quote}{secret}{quote}"
    try:
        re.compile(made.replace("(?dU)", ""))
    except re.error as error:
        raise ValueError(f"not a pattern: {error}") from error
    return made


@dataclass(frozen=True)
class Rule:
    """A detector by patterns. ``parts`` are (pattern, group); a line without any of ``marks`` (in lower case if ``fold``) or, in lower case, ``folded`` can't match."""

    name: str
    kind: str
    parts: list[tuple[str, int]]
    marks: list[str] = field(default_factory=list)
    fold: bool = False
    folded: list[str] = field(default_factory=list)


_PASS = "(?:p(?:ass|assword|w|wd)|key|token)"
_SHORT = "(?:p(?:assword|ass|wd)|token|key)"
_UNION = "(?:[-_]|)"
_CLOUD = f"(?:ibm{_UNION}cloud{_UNION}iam|ibm{_UNION}cloud|ibm{_UNION}iam|ibm|cloud{_UNION}iam|cloud|iam|){_UNION}(?:api|)"

RULES = [
    Rule("AWSKeyDetector", "AWS Access Key", [("A(?:3T[0-9A-Z]|SIA|KIA|CCA|BIA)[A-Z0-9]{16}", 0), ("(?i)aws.{0,20}?(?:p(?:ass|assword|w|wd)|token|key).{0,20}?[\"']([/+0-9a-zA-Z]{40})[\"']", 1)], ["A3T", "ASIA", "AKIA", "ACCA", "ABIA"], folded=["aws"]),
    Rule("AzureStorageKeyDetector", "Azure Storage Account access key", [("AccountKey=[=/+0-9A-Za-z]{88}", 0)], ["AccountKey="]),
    Rule("ArtifactoryDetector", "Artifactory Credentials", [("(?:^|[=:\"\\s])AKC[0-9A-Za-z]{10,}(?:[\"\\s]|$)", 0), ("(?:^|[=:\"\\s])AP[A-F\\d][0-9A-Za-z]{8,}(?:[\"\\s]|$)", 0)], ["AKC", "AP"]),
    Rule("CloudantDetector", "Cloudant Credentials", [(assignment("(?:cl(?:oudant|ou|))", f"(?:api|){_PASS}", "([a-f0-9]{64})"), 1), (assignment("(?:cl(?:oudant|ou|))", f"(?:api|){_PASS}", "([a-z]{24})"), 1), ("(?i)https?://[\\w\\-]+:([a-f0-9]{64})@[\\w\\-]+\\.cloudant\\.com", 1), ("(?i)https?://[\\w\\-]+:([a-z]{24})@[\\w\\-]+\\.cloudant\\.com", 1)], ["cl"], True),
    Rule("IbmCloudIamDetector", "IBM Cloud IAM Key", [(assignment(_CLOUD, _SHORT, "([\\-_0-9A-Za-z]{44})(?:[^\\-_0-9A-Za-z]|$)"), 1)], ["key", "pass", "pwd", "token"], True),
    Rule("IbmCosHmacDetector", "IBM COS HMAC Credentials", [(assignment("(?:(?:ibm)?[_-]?cos[_-]?(?:hmac)?|)", "(?:secret[_-]?(?:access)?[_-]?key)", "([0-9a-f]{48})(?:[^0-9a-f]|$)"), 1)], ["secret"], True),
    Rule("SoftlayerDetector", "SoftLayer Credentials", [(assignment(f"(?:sl|softlayer){_UNION}(?:api|)", _SHORT, "([0-9a-z]{64})"), 1), ("(?i)(?:https?://)?api\\.softlayer\\.com/soap/v3(?:\\.1)?/([0-9a-z]{64})", 1)], ["sl", "softlayer"], True),
    Rule("BasicAuthDetector", "Basic Auth Credentials", [("://[^\\]\\[@!$&'()*+,;=:/?#\\s]+:([^\\]\\[@!$&'()*+,;=:/?#\\s]+)@", 1)], ["://"]),
    Rule("DiscordBotTokenDetector", "Discord Bot Token", [("[M-O][-_\\da-zA-Z]{23,25}\\.[-_\\da-zA-Z]{6}\\.[-_\\da-zA-Z]{27}", 0)], ["."]),
    Rule("GitHubTokenDetector", "GitHub Token", [("(gh[oprsu])_[0-9a-zA-Z_]{36}", 1)], ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]),
    Rule("GitLabTokenDetector", "GitLab Token", [("(gl(?:pat|dt|ft|soat|rt))-[-_0-9a-zA-Z]{20,50}(?:\\W|$)", 1), ("(GR1348941[-_0-9a-zA-Z]{20,50})(?:\\W|$)", 1), ("glcbt-([A-Fa-f0-9]{2}_)?[-_0-9a-zA-Z]{20,50}(?:\\W|$)", 1), ("(glimt-[-_0-9a-zA-Z]{25})(?:\\W|$)", 1), ("(glptt-[-_0-9a-zA-Z]{40})(?:\\W|$)", 1), ("(glagent-[-_0-9a-zA-Z]{50,1024})(?:\\W|$)", 1), ("(gloas-[-_0-9a-zA-Z]{64})(?:\\W|$)", 1)], ["gl", "GR1348941"]),
    Rule("JwtTokenDetector", "JSON Web Token", [("eyJ[-_=0-9a-zA-Z]+\\.[-_=0-9a-zA-Z]+\\.?", 0)], ["eyJ"]),
    Rule("PrivateKeyDetector", "Private Key", [(f"BEGIN {k} KEY{e}", 0) for k, e in (("DSA PRIVATE", ""), ("EC PRIVATE", ""), ("OPENSSH PRIVATE", ""), ("PGP PRIVATE", " BLOCK"), ("PRIVATE", ""), ("RSA PRIVATE", ""), ("SSH2 ENCRYPTED PRIVATE", ""))] + [("PuTTY-User-Key-File-2", 0)], ["PRIVATE KEY", "PuTTY-User"]),
    Rule("MailchimpDetector", "Mailchimp Access Key", [("[a-z0-9]{32}-us[0-9]{1,2}", 0)], ["-us"]),
    Rule("NpmDetector", "NPM tokens", [("//.+/:_authToken=\\s*(npm_.+|[-0-9a-fA-F]{36})", 1)], ["_authToken="]),
    Rule("OpenAIDetector", "OpenAI Token", [("sk-[-_0-9a-zA-Z]*[0-9a-zA-Z]{20}T3BlbkFJ[0-9a-zA-Z]{20}", 0)], ["T3BlbkFJ"]),
    Rule("PypiTokenDetector", "PyPI Token", [(f"pypi-{k}[-_0-9a-zA-Z]{{70,}}", 0) for k in ("AgEIcHlwaS5vcmc", "AgENdGVzdC5weXBpLm9yZw")], ["pypi-"]),
    Rule("SendGridDetector", "SendGrid API Key", [("SG\\.[-_0-9a-zA-Z]{22}\\.[-_0-9a-zA-Z]{43}", 0)], ["SG."]),
    Rule("SlackDetector", "Slack Token", [("(?i)xox[abopsr]-(?:\\d+-)+[0-9a-z]+", 0), ("(?i)https://hooks\\.slack\\.com/services/T[_0-9a-z]+/B[_0-9a-z]+/[_0-9a-z]+", 0)], ["xox", "hooks.slack"], True),
    Rule("SquareOAuthDetector", "Square OAuth Secret", [("sq0csp-[-_\\\\0-9a-zA-Z]{43}", 0)], ["sq0csp-"]),
    Rule("StripeDetector", "Stripe Access Key", [("[rs]k_live_[a-zA-Z0-9]{24}", 0)], ["k_live_"]),
    Rule("TelegramBotTokenDetector", "Telegram Bot Token", [("^\\d{8,10}:[-_0-9a-zA-Z]{35}$", 0)], [":"]),
    Rule("TwilioKeyDetector", "Twilio API Key", [("AC[0-9a-z]{32}", 0), ("SK[0-9a-z]{32}", 0)], ["AC", "SK"]),
]

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[0-9])"
IP = f"(?:{_OCTET}\\.){{3}}{_OCTET}(?::\\d{{1,5}})?"
IP_NAME, IP_KIND = "IpPublicDetector", "Public IP (ipv4)"
PRIVATE_IP = "^(?:192\\.168\\.|127\\.|10\\.|169\\.254\\.|172\\.(?:1[6-9]|2[0-9]|3[01]))"
BASE64, HEX = "-_=+/\\\\0-9a-zA-Z", "0-9A-Fa-f"
BASE64_NAME, HEX_NAME, KEYWORD_NAME = "Base64HighEntropyString", "HexHighEntropyString", "KeywordDetector"
BASE64_KIND, HEX_KIND, KEYWORD_KIND = "Base64 High Entropy String", "Hex High Entropy String", "Secret Keyword"
BASE64_LIMIT, HEX_LIMIT = 4.5, 3.0

_LONG = "[-_0-9A-Za-z]{24}"
#: What a line has, byte by byte, that a detector finds something in: a pattern for RE2 in Latin-1. Each is implied by the
#: detector's patterns, as ``FOLDED`` stands for letters of others that Java takes for ASCII ones if case doesn't matter.
SIGNS: dict[str, str] = {
    "AWSKeyDetector": "A(?:3T|SIA|KIA|CCA|BIA)[0-9A-Z]{8}|[\"'][/+0-9A-Za-z]{40}",
    "AzureStorageKeyDetector": "AccountKey=",
    "ArtifactoryDetector": "AKC[0-9A-Za-z]|AP[0-9A-F\\x80-\\xff]",
    "CloudantDetector": _LONG,
    "IbmCloudIamDetector": _LONG,
    "IbmCosHmacDetector": _LONG,
    "SoftlayerDetector": _LONG,
    "BasicAuthDetector": "://[^/@:?#]+:[^/@:?#]+@",
    "DiscordBotTokenDetector": "[-_0-9a-zA-Z\\x80-\\xff]{6}\\.[-_0-9a-zA-Z\\x80-\\xff]{6,}\\.[-_0-9a-zA-Z\\x80-\\xff]{6}",
    "GitHubTokenDetector": "gh[oprsu]_",
    "GitLabTokenDetector": "gl(?:pat|dt|ft|soat|rt|cbt|imt|ptt|agent|oas)-|GR1348941",
    "JwtTokenDetector": "eyJ",
    "PrivateKeyDetector": "PRIVATE KEY|PuTTY-User",
    "MailchimpDetector": "[a-z0-9]{8}-us[0-9]",
    "NpmDetector": "_authToken=",
    "OpenAIDetector": "T3BlbkFJ",
    "PypiTokenDetector": "pypi-Ag",
    "SendGridDetector": "SG\\.[-_0-9a-zA-Z]{8}",
    "SlackDetector": "(?i:xox[abopsr]-|hooks\\.slack)",
    "SquareOAuthDetector": "sq0csp-",
    "StripeDetector": "[rs]k_live_",
    "TelegramBotTokenDetector": "[0-9\\x80-\\xff]{8}:",
    "TwilioKeyDetector": "(?:AC|SK)[0-9a-z]{8}",
    IP_NAME: "[0-9]\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]",
}
#: The letters U+0130, U+0131, U+017F and U+212A in UTF-8.
FOLDED = "\\xc4[\\xb0\\xb1]|\\xc5\\xbf|\\xe2\\x84\\xaa"

# keyword rules: name = value in five families of languages
_KEYS = "|".join([f"{k}_?key" for k in "client private priv database db account service auth api".split()] + ["database_?pass", "db_?pass", "key_?pass", "contrase(?:ñ|n)a", "secret", "p(?:assword|asswd|wd)"])
SIGNS[KEYWORD_NAME] = "(?i:" + _KEYS.replace("(?:ñ|n)a", "") + ")"
_K = f"(?:{_KEYS})\\w*"
_C = "(?:[\\]\\'\"]{0,2})?"
_S = "([^\\x0B'\"]*\\w[^\\x0B'\"]*[^\\x0B,'\"` ])"
_S_JAVA = "((?:[^\\x0B'\"\\w]*+)\\w[^\\x0B'\"]*[^\\x0B,'\"` ])"
_LOOSE, _STRICT = ['"', "'", ""], ['"', "'", "`"]


#: What a line has that a keyword's pattern matches in: its quote and its sign. The pattern isn't tried on others.
NEEDS: dict[str, list[str]] = {}


def _quoted(before: str, quotes: list[str], after: str = "", sign: str = "") -> list[str]:
    patterns = ["(?i)" + before + q + _S + q + after for q in quotes]
    NEEDS.update({p: [n for n in (sign, q + after) if n] for p, q in zip(patterns, quotes)})
    return patterns


_EQUAL = f"{_K}{_C}\\s*(?:!==?|={{1,3}})\\s*"
_COMPARED = [q + _S + q + f"\\s*[!=]{{2,3}}\\s*\\w*(?:{_KEYS})" for q in _STRICT]
NEEDS.update({p: [q] for p, q in zip(_COMPARED, _STRICT)})
_SEMICOLON = _quoted(f"{_K}[^\\s]{{0,50}}?\\s*", _STRICT, ";")
#: Groups in order; of each group the first variant that matches yields one secret.
KEYWORD_GROUPS: dict[str, list[list[str]]] = {
    "config": [_quoted(f"{_K}{_C}:\\s*", _LOOSE, sign=":"), _COMPARED, _quoted(_EQUAL, _LOOSE, sign="="), _SEMICOLON],
    "go": [_quoted(f"{_K}{_C}\\s*:=\\s*", _LOOSE, sign=":="), _COMPARED, _quoted(_EQUAL, _LOOSE, sign="="), _SEMICOLON],
    "c": [_quoted(f"{_K}(?:\\[[0-9]*\\])?\\s*[!=]{{1,2}}\\s*@?", ['"'])],
    "cpp": [[f"{_K}(?:\\.assign)?\\(\"{_S}\""], _quoted(_EQUAL, _STRICT, sign="=")],
    "quotes": [_quoted(f"{_K}{_C}:\\s*", _STRICT, sign=":"), _COMPARED, _quoted(_EQUAL, _STRICT, sign="="), _SEMICOLON, _quoted(f"{_K}{_C}\\s*=>?\\s*", _STRICT, sign="=")],
}
#: Lines without any of these have no keyword; in lower case.
KEYWORD_MARKS = ["key", "pass", "pwd", "secret", "contrase"]
#: A comparison with a keyword; without it the group of comparisons, whose values begin anywhere, can't match.
COMPARISON = f"[!=]{{2,3}}\\s*\\w*(?:{_KEYS})"
COMPARED = _COMPARED
FAMILIES = {"config": "yaml yml eyaml cnf conf cfg cf ini properties toml".split(), "go": ["go"], "c": ["m", "cs", "c"], "cpp": ["cpp"]}

# filters
NOT_TEXT = sorted(".sum .map .mo .jar .jpg .jpeg .tar .tif .tiff .ttf .xls .xlsx .pdf .png .psd .prefs .gif .gz .ico .iml .ipr .iws .svg .s7z .rar .realm .webp .woff .zip .lock .7z .bin .bmp .bz2 .class .css .dmg .doc .eot .exe".split(), key=lambda x: (len(x), x))
LOCKS = sorted("Gemfile.lock Cargo.lock yarn.lock poetry.lock Pipfile.lock Podfile.lock composer.lock package-lock.json packages.lock.json Package.resolved Cartfile.resolved Brewfile.lock.json".split(), key=lambda x: (len(x), x))
UUID = "(?i)" + "-".join(f"[0-9a-f]{{{n}}}" for n in (8, 4, 4, 4, 12))
ID_BEFORE = "(?i)(?:^(?:my|user|)id|_id)s?[^0-9a-z]"
#: What may stand before the sign may be nothing, so it isn't looked for.
INDIRECT = "(?::=?|[!=]{1,3})\\s*[\\w.\\-]+[\\[\\(][^\\x0B]*[\\]\\)]"
INDIRECT_BYTES = 1000
COMMENTS = [("#", ""), ("//", ""), ("/\\*", " *\\*/"), ("'", ""), ("--", ""), ("<!--[# \\t]*?", " *?-->")]
_UPPER, _DIGITS, _HEXES = "".join(map(chr, range(65, 91))), "0123456789", "0123456789ABCDEF"
SEQUENCES = [_UPPER * 2 + _DIGITS + "+/", _DIGITS + _UPPER * 2 + "+/", (_DIGITS + _UPPER) * 2, _DIGITS * 2, _HEXES * 2, _UPPER + "=/"]


def allowlist(start: str, end: str, nextline: bool) -> str:
    """The pragma that exempts its own line, or the next one."""
    if nextline:
        return f"^[ \\t]*{start} *pragma: ?allowlist[ -]nextline[ -]secret.*?{end}[ \\t]*$"
    return f"[ \\t]*{start} *pragma: ?(?:white|allow)list[ -]secret.*?{end}[ \\t]*$"


#: Redaction rules, applied in order.
REDACTIONS = [
    ("sk-ant-[-0-9a-zA-Z]{20,}", "[REDACTED_API_KEY]"),
    ("sk-[0-9a-zA-Z]{20,}", "[REDACTED_API_KEY]"),
    ("[rps]k_(?:test|live)_[0-9a-zA-Z]{20,}", "[REDACTED_API_KEY]"),
    ("Bearer\\s+[-._0-9a-zA-Z]{20,}", "[REDACTED_BEARER_TOKEN]"),
    ("(?i)(?:secret|project|api)[_-]?key[=:\\s]+['\"]?[-_0-9a-zA-Z]{16,}['\"]?", "[REDACTED_KEY]"),
]
