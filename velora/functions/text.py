"""String functions as Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from velora.functions.vector import let

#: The white space that Unicode-aware stripping removes; Java and RE2 read it alike.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What a comparison of texts ignores besides white space.
IGNORED = r".,!?'\"·…~\-"
#: Decoration of a gloss token.
DECORATION = r"[\[\]{}()<>]"
#: Grammar features in order, with the surface pattern and the terms to search for.
FEATURES = (
    ("부정", r"(안\s|않|못\s|못하|없다|없어|아니)", "부정법 부정문 부정표현"),
    ("의문", r"(\?|나요|까요|습니까|는가|니\?|무엇|어디|누구|언제|왜|어떻게)", "문장종결 의문문 의문표지"),
    ("명령청유", r"(세요|해라|하자|합시다|십시오|어라)", "문장종결 명령문 청유문"),
    ("조건", r"(만약|면\s|려면|다면|경우)", "문장구조 조건 이어진문장 종속적 연결"),
    ("시제", r"(어제|내일|오늘|지난|다음|전에|후에|았다|었다|겠다|것이다)", "시간 부사어 시제 시간표현"),
    ("인용", r"(라고|고\s말|말했|물었|이라며|한다고)", "역할전환 인용 담화"),
    ("수량", r"([0-9]+|한\s|두\s|세\s|여러|많이|조금|모두)", "수량 수사 지숫자"),
    ("비교", r"(보다|더\s|가장|제일|만큼)", "비교 정도 부사어"),
    ("피동사동", r"(되다|되었|시키|받다|당하)", "단어 변형 동사 유형 일치동사"),
    ("위치이동", r"(에서|으로|까지|에게|한테)", "문장성분 부사어 공간 활용"),
    ("접속", r"(그리고|그러나|하지만|그래서|때문|니까)", "문장구조 이어진문장 접속표지"),
)
#: Fixed value: what to search for if no feature shows.
NO_FEATURE = "문장성분 문장구조 어순"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(x, f"[{SPACE}]+", " "))


def tokens(x: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(x, f"[{SPACE}]+"), lambda t: t != "")


def lemma(x: Column) -> Column:
    """A gloss token without decoration and sense number."""
    return F.regexp_replace(strip(F.regexp_replace(x, DECORATION, "")), "[0-9]+$", "")


def comparison_key(x: Column) -> Column:
    """Equal for texts that differ in white space and marks only."""
    return F.regexp_replace(x, f"[{SPACE}{IGNORED}]+", "")


def hangul_runs(x: Column) -> Column:
    """The set of Hangul runs."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit("[가-힣]+"), F.lit(0))))


def bucket(x: Column, seed: int = 42) -> Column:
    """A number from 0 to 1 by the md5 of seed and text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), x)), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def feature_flags(x: Column) -> Column:
    """Whether each feature shows. Texts without Hangul, found in one pass, are only searched for what patterns hold besides: each of their other choices has a Hangul letter."""
    hangul = x.rlike("[가-힣]")

    def shows(pattern: str) -> Column:
        other = [p for p in pattern[1:-1].split("|") if not re.search("[가-힣]", p)]
        return F.when(hangul, x.rlike(pattern)).when(x.isNotNull(), x.rlike("|".join(other)) if other else F.lit(False))

    return F.array(*[shows(pattern) for _, pattern, _ in FEATURES])


def tags_of(flags: Column) -> Column:
    return F.array_compact(F.array(*[F.when(flags[k], F.lit(name)) for k, (name, _, _) in enumerate(FEATURES)]))


def query_of(flags: Column) -> Column:
    terms = F.concat_ws(" ", *[F.when(flags[k], F.lit(words)) for k, (_, _, words) in enumerate(FEATURES)])
    return F.when(terms == "", F.lit(NO_FEATURE)).otherwise(terms)


def feature_tags(x: Column) -> Column:
    return let(feature_flags(x), tags_of)


def feature_query(x: Column) -> Column:
    return let(feature_flags(x), query_of)


def word_ngrams(x: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside word boundaries: words are padded by a space on either side; a padded word as long as n counts once, and larger n skip it."""
    padded = F.transform(tokens(F.lower(x)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(w: Column, n: int) -> Column:
        size = F.char_length(w)
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def grams(w: Column) -> Column:
        return F.concat(*[of_size(w, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(padded, grams))


def sentences(x: Column) -> Column:
    """Parts after . ! ? with white space, or after the plain ending."""
    return F.split(x, r"(?<=[.!?])\s+|(?<=다\.)\s*", -1)


def word_of(token: Column) -> Column:
    """The word of word/POS."""
    return F.split(token, "/")[0]


def pos_of(token: Column) -> Column:
    return F.coalesce(F.get(F.split(token, "/"), F.lit(1)), F.lit("OTHER"))


def alphabetic(words: Column) -> Column:
    """The words that are letters only."""
    return F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))


def fixed_tokens(words: Column, size: int = 20) -> Column:
    """struct(tokens, n): words of a caption between start and end marks, filled to size + 2; of longer captions the first size words."""
    inner = F.slice(words, 1, size)
    own = F.concat(F.array(F.lit("sos/OTHER")), inner, F.array(F.lit("eos/OTHER")))
    fill = F.array_repeat(F.lit("unk/OTHER"), F.lit(size) - F.size(inner))
    return F.struct(F.concat(own, fill).alias("tokens"), (F.size(inner) + 2).alias("n"))


def natural_key(x: Column) -> Column:
    """A text to sort by, in which runs of digits compare as numbers, however long: the number of digits that count, then those digits."""
    runs = F.regexp_extract_all(x, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    key = lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(r)).cast("string"), 10, "0"), number(r))).otherwise(r)
    return F.array_join(F.transform(runs, key), "")


def motion_string(codes: Column, size: int = 512) -> Column:
    """Codes as marked text between the start and end marks."""
    return F.concat(F.lit(f"<motion_id_{size}>"), F.array_join(F.transform(codes, lambda c: F.concat(F.lit("<motion_id_"), c.cast("string"), F.lit(">"))), ""), F.lit(f"<motion_id_{size + 1}>"))


def between(x: Column, start: str, end: str, default: str) -> Column:
    """Text between the first start and the first end mark; default if either is missing."""
    a, b = F.locate(start, x), F.locate(end, x)
    return F.when((a > 0) & (b > 0), F.substring(x, a + len(start), F.greatest(b - a - len(start), F.lit(0)))).otherwise(F.lit(default))


def motion_codes(x: Column, size: int = 512) -> Column:
    """Codes between the marks; none at all count as one code 0."""
    inner = between(x, f"<motion_id_{size}>", f"<motion_id_{size + 1}>", "<motion_id_0>")
    codes = F.transform(F.regexp_extract_all(inner, F.lit(r"<motion_id_(\d+)>"), F.lit(1)), lambda c: c.cast("int"))
    return F.when(F.size(codes) == 0, F.array(F.lit(0))).otherwise(codes)


def marked(codes: Column) -> Column:
    """Codes as marked text without start and end."""
    return F.array_join(F.transform(codes, lambda c: F.concat(F.lit("<motion_id_"), c.cast("string"), F.lit(">"))), "")


def motion_parts(codes: Column, frames: Column, down: int = 4, size: int = 512, predict: float = 0.2, inbetween: float = 0.25) -> dict[str, Column]:
    """What the motion placeholders stand for, by slices of the codes between their start and end marks.

    The cut falls behind so many marks as the ratio of the clip's units holds, counted from the start mark: head and tail split at predict, the
    masked part lies between inbetween and the rest.
    """
    every = F.concat(F.array(F.lit(size)), codes.cast("array<int>"), F.array(F.lit(size + 1)))
    cut = lambda ratio: F.least((frames / F.lit(float(down)) * F.lit(ratio) + 1).cast("int"), F.size(every))
    head, lo, hi = cut(predict), cut(inbetween), cut(1 - inbetween)
    upto = lambda k: F.slice(every, F.lit(1), k)
    beyond = lambda k: F.slice(every, k + 1, F.size(every))
    hidden = F.array_repeat(F.lit(size + 2), F.greatest(hi - lo, F.lit(0)))
    return {
        "<Motion_Placeholder>": marked(every),
        "<Motion_Placeholder_s1>": marked(F.concat(upto(head), F.array(F.lit(size + 1)))),
        "<Motion_Placeholder_s2>": marked(F.concat(F.array(F.lit(size)), beyond(head))),
        "<Motion_Placeholder_Masked>": marked(F.concat(upto(lo), hidden, beyond(hi))),
    }


def fill(template: Column, caption: Column, codes: Column, frames: Column, fps: float = 20.0, quoted: bool = False, **parts) -> Column:
    """Fill the seven placeholders of an instruction template; quoted puts the caption in quotation marks."""
    values = {
        "<Caption_Placeholder>": F.concat(F.lit('"'), caption, F.lit('"')) if quoted else caption,
        "<Frame_Placeholder>": frames.cast("string"),
        "<Second_Placeholder>": F.format_string("%.1f", F.floor(frames / F.lit(fps)).cast("double")),
        **motion_parts(codes, frames, **parts),
    }
    whole = template
    for name, value in values.items():  # a value is made only where its placeholder stands
        asked = F.contains(template, F.lit(name)) | F.contains(caption, F.lit(name))
        whole = F.replace(whole, F.lit(name), F.when(asked, value).otherwise(""))
    return F.when(caption.isNotNull() & codes.isNotNull() & frames.isNotNull(), whole)


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function."""
    return x.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))
