"""Text functions as column expressions: keywords, accents, redaction of secrets, categories, paths, predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The commonest grammatical words of English, Portuguese, Spanish and French; pass others where a collection needs them.
STOP_WORDS = tuple(
    sorted(
        set(
            "a an the and or but if so as at by for from in into of on to with is are was were be been it its this that these those he she we you they not no do does did has have had can will would should must than then when where which who what how all any each more most only same also just very"
            " o os as um uma de da do das dos em na nas nos para por com que se mais como mas foi ser são não seu sua ele ela isso este esta onde quando muito sobre entre até"
            " el la los las un del al y en con sin su sus pero fue más muy ya si lo está cuando donde también"
            " le les des du et est dans pour qui pas sur au aux il elle ce cette ne par plus avec sont être".split()
        )
    )
)

# Letters with accents and the plain letters they become.
ACCENTED = "áàâãäÁÀÂÃÄéèêëÉÈÊËíìîïÍÌÎÏóòôõöÓÒÔÕÖúùûüÚÙÛÜçÇñÑýÿÝ"
PLAIN = "aaaaaaaaaaeeeeeeeeiiiiiiiioooooooooouuuuuuuuccnnyyy"

# The rules of redaction, in the order in which they apply. (pattern, replacement, ignores case)
_KEY, _GUARD = r"""\s*[:=]\s*['"]?""", r"""['"]?"""
SECRETS = (
    (rf"(api[_-]?key|apikey|access[_-]?key){_KEY}[a-zA-Z0-9_\-./+=]{{20,}}{_GUARD}", "$1=[REDACTED]", True),
    (rf"(token|bearer|auth[_-]?token|access[_-]?token|refresh[_-]?token){_KEY}[a-zA-Z0-9_\-./+=]{{20,}}{_GUARD}", "$1=[REDACTED]", True),
    (rf"(password|passwd|pwd){_KEY}[^'\"\s]{{8,}}{_GUARD}", "$1=[REDACTED]", True),
    (rf"(secret|credential){_KEY}[^'\"\s]{{8,}}{_GUARD}", "$1=[REDACTED]", True),
    (r"-----BEGIN\s+(?:RSA\s+|EC\s+|OPENSSH\s+|DSA\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+|EC\s+|OPENSSH\s+|DSA\s+)?PRIVATE\s+KEY-----", "[REDACTED]", False),
    (r"eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*", "[REDACTED]", False),
    (r"AKIA[0-9A-Z]{16}", "[REDACTED]", True),
    (r"gh[pouscr]_[a-zA-Z0-9]{36}", "[REDACTED]", True),
    (r"xox[baprs]-[0-9a-z\-]{10,}", "[REDACTED]", True),
    (rf"(sk|pk|private[_-]?key){_KEY}[a-zA-Z0-9_\-./+=]{{8,}}{_GUARD}", "$1=[REDACTED]", True),
    (r"bearer\s+[a-zA-Z0-9_\-.]{10,}", "bearer [REDACTED]", True),
    (r"((?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis))://[^@\s]*:[^@\s]+@", "$1://[REDACTED]@", True),
)

# The first pattern found in a text names its category. < and > stand for word edges.
CATEGORIES = (
    (r"(daily|weekly|monthly).*(log|summary|report|relatório)", "summary"),
    (r"<(resumo|summary|compacted|consolidado|consolidated)>", "summary"),
    (r"<(overview|balanço|relatório|recap)>", "summary"),
    (r"<(reunião|meeting|standup)>", "event"),
    (r"<(lembrete|reminder|alerta|alert|aviso)>", "event"),
    (r"<\d{1,2}[/:h]\d{2}>", "event"),
    (r"<(hoje|amanhã|ontem|tomorrow|yesterday|today)>", "event"),
    (r"<(segunda|terça|quarta|quinta|sexta|sábado|domingo)>", "event"),
    (r"<(monday|tuesday|wednesday|thursday|friday|saturday|sunday)>", "event"),
    (r"<(deploy|rollback|hotfix|incident|outage)>", "event"),
    (r"<(comprou|pagou|transferiu|depositou|sacou)>", "event"),
    (r"<(saldo|fatura|invoice|bill)>.*<(R\$|BRL|\d+[.,]\d{2})>", "event"),
    (r"<(prefere|prefer[es]?|gosta\s+de|likes?|sempre\s+usa|always\s+use)>", "preference"),
    (r"<(não\s+gosta|dislikes?|evita|avoids?|nunca|never)>", "preference"),
    (r"<(modo|mode|theme|layout)>.*(escuro|dark|claro|light)", "preference"),
    (r"<(favorit[oa]|favorite|preferid[oa]|preferred)>", "preference"),
    (r"<(decisão|decided|escolh[aei]\s+usar|chose|picked)>", "decision"),
    (r"<(arquitetura|architecture|refator|refactor|pattern|design)>", "decision"),
    (r"<(learned|aprend[ie]|discovered|lesson)>", "learning"),
)

# What marks a transcript line as noise.
NOISE = ("<task-notification", "<tool-use-id>", "hookspecificoutput", "permissiondecision", "pretooluse", "posttooluse")
LOW_PREFIXES = ("i'll ", "i’ll ", "let me ", "now ", "great", "got it", "excellent", "i have ", "vou ", "agora ", "perfeito", "ótimo")
# Dangerous commands; the last two only when piped to a shell. Words that mention memory.
DANGEROUS = ("rm -rf /", ":(){:|:&};:", "dd if=/dev/zero", "mkfs", "format c:", "nc -l")
PIPED = ("curl", "wget")
MEMORY_WORDS = ("memory", "fact", "decision", "preference")
# Categories that front matter may name.
FRONT_CATEGORIES = ("summary", "technical", "decision", "preference", "fact", "event", "learning", "plan")

_EDGE_TRIM = ".,;:!?\"'()[]{}<>«»“”‘’`*_~-/\\|@#$%^&+="


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def normalize_accents(text: Column) -> Column:
    """Accented Latin letters as plain lower-case ones; other characters stay."""
    return F.translate(text, ACCENTED, PLAIN)


def normalize_entity(text: Column) -> Column:
    """Lower case without combining marks; letters that are one code point with their accent keep it."""
    return F.regexp_replace(F.lower(text), r"\p{Mn}", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes in lower-case hex."""
    return F.sha2(text, 256)


def fields(text: Column) -> Column:
    """The runs between white space; none for an empty text."""
    trimmed = F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def is_keyword(word: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """At least two bytes, no stop word, not only digits, not only punctuation and symbols."""
    return (F.octet_length(word) >= 2) & ~word.isin(*stop_words) & ~word.rlike(r"^\p{Nd}+$") & ~word.rlike(r"^[\p{P}\p{S}]+$")


def keywords(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The keywords of a text in order, repeats included: lower case, trimmed of punctuation."""
    trimmed = F.transform(fields(F.lower(text)), lambda w: F.btrim(w, F.lit(_EDGE_TRIM)))
    return F.filter(trimmed, lambda w: is_keyword(w, stop_words))


def redact_secrets(text: Column) -> Column:
    """Keys, tokens, passwords and the like as [REDACTED]; later rules see what earlier ones left."""
    for pattern, replacement, fold in SECRETS:
        text = F.regexp_replace(text, f"(?i){pattern}" if fold else pattern, replacement)
    return text


def categorize(text: Column) -> Column:
    """The category of the first pattern found in lower case, else fact; null for null. Word edges are those of ASCII words."""
    # every pattern begins with a word character at its first edge, so that looking back is enough there
    begin, end = r"(?<![a-z0-9_])", r"(?:(?<=[a-z0-9_])(?![a-z0-9_])|(?<![a-z0-9_])(?=[a-z0-9_]))"
    low, out = F.lower(text), F.lit("fact")
    for pattern, category in reversed(CATEGORIES):
        expression = pattern.replace("R\\$|BRL", "r\\$|brl").replace("<", begin, 1)
        head, *rest = expression.split(">", 1)
        expression = head + end + rest[0].replace("<", begin).replace(">", end) if rest else head
        out = F.when(low.rlike(expression), F.lit(category)).otherwise(out)
    return F.when(text.isNotNull(), out)


def is_useful(text: Column, assistant: Column) -> Column:
    """Whether a transcript text is worth keeping."""
    trimmed = F.trim(text)
    low = F.lower(trimmed)
    noisy = low.startswith("tool:") | low.contains('"tool_use"') | _any([low.contains(x) for x in NOISE])
    idle = assistant & _any([low.startswith(x) for x in LOW_PREFIXES]) & (F.octet_length(trimmed) < 240)
    return F.coalesce((F.octet_length(trimmed) >= 12) & ~noisy & ~idle, F.lit(False))


def is_dangerous(code: Column) -> Column:
    low = F.lower(code)
    piped = _any([low.contains(x) for x in PIPED]) & low.contains("|") & low.contains("sh")
    return F.coalesce(_any([low.contains(x) for x in DANGEROUS]) | piped | (low.contains("bash") & low.contains("|") & _any([low.contains(x) for x in PIPED])), F.lit(False))


def mentions_memory(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(_any([low.contains(x) for x in MEMORY_WORDS]), F.lit(False))


def dir_to_path(name: Column) -> Column:
    """-home-user-project as /home/user/project; '' unless it starts with a dash and has two parts."""
    body = F.substr(name, F.lit(2))
    fits = name.startswith("-") & (F.size(F.split(body, "-")) >= 2) & (body != "")
    return F.when(fits, F.concat(F.lit("/"), F.replace(body, F.lit("-"), F.lit("/")))).otherwise(F.lit(""))


def front_matter(document: Column) -> Column:
    """The block between the first two --- lines of a document that starts with one; '' if there is none."""
    return F.regexp_extract(document, r"^---\n([\s\S]*?)\n---", 1)


def front_matter_category(front: Column) -> Column:
    """The value of type: or category: in front matter, if it is known; project and global are preferences."""
    value = F.regexp_extract(front, r"""(?m)^\s*(?:type|category):\s*["']?([^"'\s]*)["']?\s*$""", 1)
    return F.when(value.isin("project", "global"), "preference").when(value.isin(*FRONT_CATEGORIES), value).otherwise("")


def front_matter_map(front: Column) -> Column:
    """The key: value lines of front matter as a map; lines without a colon are left out, the last of equal keys holds."""
    lines = F.filter(F.split(front, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.btrim(F.trim(F.substr(x, F.locate(":", x) + 1)), F.lit("\"'")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q.key == p.key))
    return F.map_from_entries(last)


def normalize_project_spec(spec: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(spec)), r"[.\-_ ]", "")


def truncate_display(text: Column, n: int) -> Column:
    """One line of at most n characters, with ... where it was cut."""
    line = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > n, F.concat(F.left(line, F.lit(n)), F.lit("..."))).otherwise(line)


def truncate_at_boundary(text: Column, n: int) -> Column:
    """At most n characters, cut back to the last white space and trimmed on the right; a single long word is cut hard."""
    head = F.left(text, F.lit(n))
    back = F.regexp_extract(head, r"^([\s\S]*)\s", 1)
    cut = F.when(F.substr(text, F.lit(n + 1), F.lit(1)).rlike(r"^\s"), head).when(back == "", head).otherwise(back)
    return F.when(F.length(text) <= n, text).otherwise(F.regexp_replace(cut, r"\s+$", ""))


def split_on_punctuation(text: Column) -> Column:
    """White-space runs, with each punctuation mark and symbol a token of its own."""
    return F.regexp_extract_all(text, F.lit(r"([\p{P}\p{S}]|[^\s\p{P}\p{S}]+)"), F.lit(1))


def is_text(data: Column) -> Column:
    """Valid UTF-8 without a zero character."""
    return F.is_valid_utf8(data) & ~data.contains("\u0000")


def format_time(time: Column) -> Column:
    """A timestamp as 2006-01-02 15:04, and in RFC 3339 by rfc3339."""
    return F.date_format(time, "yyyy-MM-dd HH:mm")


def rfc3339(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssXXX")


def matches_intent(text: Column, intent: Column) -> Column:
    """Whether some word of the intent is a part of the text, in lower case."""
    low = F.lower(text)
    return F.exists(fields(F.lower(intent)), lambda w: low.contains(w))


def contains_entity(text: Column, words: Column, entities: Column) -> Column:
    """Whether an entity is part of the text or equals one of its keywords; case is ignored."""
    low, known = F.lower(text), F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.lower(w))
    return F.exists(entities, lambda e: low.contains(F.lower(e)) | F.array_contains(known, F.lower(e)))
