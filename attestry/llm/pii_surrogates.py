r"""Surrogates for personal data, in DataFrame and SQL functions only.

One regular expression finds e-mail addresses, phone numbers, IPv4 addresses, payment card and account numbers, social security
numbers and personal names (after a title, or a known given name with a surname). Each distinct entity (kind and normal form, so
that other spellings, cases and separators mean the same one) gets one surrogate for the whole corpus, derived from a secret key:

* e-mail: letters, digits and punctuation stay letters, digits and punctuation; the domain ends in the reserved ``example``;
* phone, card, security number: digits in the place of digits, separators as they were; country code and a card's first digit and
  its Luhn remainder stay; security numbers go to the range that is never issued;
* IPv4: an address of the reserved range 240.0.0.0/4;
* names: given name and surname apart, in the script (Latin, Cyrillic), the gender (title or given name) and the case they had.

Surrogates are checked against one another and against all original entities of the kind; whoever clashes is derived again with
the next attempt, until none does. From the third attempt on names and e-mail addresses grow (a syllable, a letter, each attempt), so there are always
enough; IP addresses and security numbers leave their reserved range for the whole space of their format and keep their form, as cards do. Phone
numbers, whose length isn't fixed, get more digits from the seventh attempt on, which only forms of a few digits come to. Where the entities of
a fixed form take up nearly half of its values, no such surrogates exist: that is an error after 100 attempts. So distinct entities stay
distinct, and one entity reads the same in every document.

A name is found after a title, after a label such as ``Name:`` or ``Sincerely,``, or by a common given name in front of a surname; others are
not found. Letters of e-mail addresses keep their script (Latin, Cyrillic), not their case, which addresses don't tell apart.

Defined cases: the columns n_entities and kinds get an underscore at the end where ``docs`` has columns of that name; null and empty texts stay as they are; repeated rows are rewritten alike; long texts are searched whole; an empty
table gives an empty result; all other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import release, stage

# Titles by gender, and given names that tell a person's name without a title.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Signora", "г-жа", "госпожа"), "u": ("Dr", "Prof")}
GIVEN = {
    "m": ("Alexander", "Andrew", "Anthony", "Carlos", "Charles", "Daniel", "David", "Edward", "Hans", "James", "Jean", "John", "Jürgen", "Michael", "Paul", "Peter", "Pierre", "Richard", "Robert", "Thomas", "William", "Александр", "Иван", "Сергей",
          "Adam", "Albert", "Antonio", "Benjamin", "Brian", "Christian", "Christopher", "Claude", "Donald", "Eric", "Francisco", "François", "Frank", "Fritz", "George", "Giovanni", "Henry", "Jacques", "Jason", "Javier", "Jeffrey", "Joseph", "José", "Juan", "Karl", "Kenneth", "Klaus", "Kevin", "Luis", "Manuel", "Marco", "Mark", "Martin", "Matthew", "Miguel", "Mohammed", "Nicolas", "Otto", "Patrick", "Pedro", "Philippe", "Stefan", "Stephen", "Steven", "Timothy", "Werner", "Wolfgang", "Алексей", "Андрей", "Владимир", "Дмитрий", "Николай", "Павел", "Пётр"),
    "f": ("Alice", "Anna", "Barbara", "Carmen", "Catherine", "Elizabeth", "Emily", "Françoise", "Helga", "Jennifer", "Julia", "Karen", "Laura", "Linda", "Margaret", "Maria", "Mary", "Sarah", "Sophie", "Susan", "Ursula", "Анна", "Мария", "Ольга",
          "Amanda", "Amy", "Ana", "Andrea", "Angela", "Ashley", "Brigitte", "Camille", "Carol", "Caroline", "Charlotte", "Chloé", "Christine", "Claudia", "Cristina", "Deborah", "Donna", "Dorothy", "Elena", "Emma", "Eva", "Francesca", "Gabriele", "Giulia", "Hannah", "Heike", "Helen", "Ingrid", "Isabel", "Jessica", "Karin", "Katharina", "Kimberly", "Léa", "Lisa", "Lucía", "Marie", "Melissa", "Michelle", "Monika", "Nancy", "Nathalie", "Pamela", "Patricia", "Petra", "Rebecca", "Renate", "Ruth", "Sabine", "Sandra", "Sharon", "Stephanie", "Екатерина", "Елена", "Ирина", "Наталья", "Светлана", "Татьяна"),
}

_NAME = r"\p{Lu}[\p{L}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = "(?:" + "|".join(f"{t}|{t.upper()}" for g in TITLES.values() for t in g) + r")\.?"
#: Words that a name follows.
LABELS = ("Name:", "name:", "Contact:", "contact:", "Author:", "author:", "Signed,", "Sincerely,", "Regards,", "regards,", "my name is", "My name is", "Nom :", "Имя:")
_LABEL = "(?:" + "|".join(LABELS) + ")"
_GIVEN = "(?:" + "|".join(n for g in GIVEN.values() for n in g) + ")"
EMAIL = r"[\p{L}0-9._%+-]+@(?:[\p{L}0-9-]+\.)+\p{L}{2,}"
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|(?<![0-9])[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
PERSON = rf"(?<!\p{{L}})(?:{_TITLE} {_NAME}(?: {_NAME})?|(?<={_LABEL}[ \n]){_NAME}(?: {_NAME})?|{_GIVEN} {_NAME})"
ANY = f"{EMAIL}|{IP}|{SSN}|{CARD}|{PHONE}|{PERSON}"


def _hint() -> str:
    """What every entity holds, as a cheap first look: a digit, an at sign, or a title or given name with a blank behind it. Names are
    grouped by their first letter, so that most characters are passed over after one test."""
    by_first: dict[str, list[str]] = {}
    for word in [x for g in TITLES.values() for t in g for x in (t + " ", t + ". ", t.upper() + " ", t.upper() + ". ")] + [n + " " for g in GIVEN.values() for n in g] + list(LABELS):
        by_first.setdefault(word[0], []).append(word[1:].replace(".", "[.]"))
    return f"(?=[0-9@{''.join(by_first)}])(?:[0-9@]|" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"


HINT = _hint()

#: Syllables of made-up names by script, and endings by gender.
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ka ke ko la le li lo ma me mi mo na ne no pa ra re ri ro sa so".split(),
    "cyrillic": "ба бе бо да де ди до фа фе га го ка ке ко ла ле ли ло ма ме ми мо на не но па ра ре ри ро са со".split(),
}
ENDINGS = {"latin": {"m": "n", "f": "na", "u": "l"}, "cyrillic": {"m": "н", "f": "на", "u": "л"}}


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(xs) -> str:
    return "array(" + ",".join(_literal(x) for x in xs) + ")"


def _gender(title: str, given: str) -> str:
    by_title = " ".join(f"WHEN rtrim('.', lower({title})) IN ({','.join(_literal(t.lower()) for t in TITLES[g])}) THEN '{g}'" for g in "mf")
    by_name = " ".join(f"WHEN {given} IN ({','.join(map(_literal, GIVEN[g]))}) THEN '{g}'" for g in "mf")
    return f"CASE {by_title} {by_name} ELSE 'u' END"


def _piece(kind: str, norm: str, raw: str) -> str:
    return f"named_struct('raw', {raw}, 'kind', {kind}, 'norm', {norm})"


#: The pieces of one entity x: title and blanks are plain text, names are parts of their own.
_KIND = f"""CASE WHEN x LIKE '%@%' THEN 'email' WHEN x RLIKE {_literal('^' + IP + '$')} THEN 'ip' WHEN x RLIKE {_literal('^' + SSN + '$')} THEN 'ssn'
  WHEN x RLIKE {_literal('^' + CARD + '$')} THEN 'card' ELSE 'phone' END"""
_NORM = "CASE WHEN x LIKE '%@%' THEN lower(x) WHEN x RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' THEN x ELSE regexp_replace(x, '[^0-9]', '') END"
_SCRIPT = "if({0} RLIKE '\\\\p{{IsCyrillic}}', 'cyrillic', 'latin')"


def _person() -> str:
    title = f"regexp_extract(x, {_literal('^(' + _TITLE + ') ')}, 1)"
    names = f"split(substring(x, if({title} = '', 1, length({title}) + 2)), ' ')"
    given = f"if(size({names}) > 1, {names}[0], '')"
    gender = _gender(title, given)
    sur = f"{names}[size({names}) - 1]"
    front = f"if({title} = '', array(), array({_piece(_literal(''), _literal(''), f'concat({title}, {_literal(" ")})')}))"
    blank = _piece("''", "''", "' '")
    first = _piece(f"concat('given-', {_SCRIPT.format(given)}, '-', {gender})", f"lower({given})", given)
    last = _piece(f"concat('surname-', {_SCRIPT.format(sur)}, '-', 'u')", f"lower({sur})", sur)
    return f"concat({front}, if({given} = '', array(), array({first}, {blank})), array({last}))"


PIECES = f"""flatten(transform(segments, (s, i) -> concat(array({_piece("''", "''", 's')}),
  if(i >= size(entities), array(), transform(array(entities[i]), x -> if(x RLIKE '^[\\\\p{{L}}]' AND NOT x LIKE '%@%', {_person()}, array({_piece(_KIND, _NORM, 'x')})))[0]))))"""

#: Bytes of the keyed hash h: B(i) is the i-th, from 0, around after 64.
_B = "cast(conv(substring(h, 1 + 2 * (({0}) % 64), 2), 16, 10) AS int)"
_DIGITS = "array_join(transform(sequence(1, {0}), i -> cast(" + _B.format("i") + " % 10 AS string)), '')"
_LUHN = """aggregate(sequence(1, length({0})), 0, (a, i) -> a + if((length({0}) - i) % 2 = 1,
  2 * cast(substring({0}, i, 1) AS int) - if(cast(substring({0}, i, 1) AS int) > 4, 9, 0), cast(substring({0}, i, 1) AS int))) % 10"""


def _mask(x: str, begin: int) -> str:
    """Letters and digits of x replaced by keyed ones, the rest as it is."""
    return f"""aggregate(split({x}, ''), named_struct('s', '', 'i', {begin}), (a, c) -> named_struct('s', concat(a.s,
  CASE WHEN c RLIKE '[0-9]' THEN cast({_B.format('a.i')} % 10 AS string) WHEN c RLIKE '\\\\p{{IsCyrillic}}' THEN substring('абвгдежзиклмнопрстуфхцчшэюя', 1 + {_B.format('a.i')} % 27, 1) WHEN c RLIKE '\\\\p{{L}}' THEN chr(97 + {_B.format('a.i')} % 26) ELSE c END), 'i', a.i + 1), a -> a.s)"""


#: Letters or syllables more than the original form needs, from the third attempt on.
_MORE = "greatest(0, attempt - 2)"
_MORE_DIGITS = "if(attempt > 6, array_join(transform(sequence(1, attempt - 6), i -> cast(" + _B.format("i + 20") + " % 10 AS string)), ''), '')"
_MORE_LETTERS = "if(attempt > 2, array_join(transform(sequence(1, attempt - 2), i -> chr(97 + " + _B.format("i + 20") + " % 26)), ''), '')"


def _name(script: str) -> str:
    return f"array_join(transform(sequence(1, 4 + {_MORE}), i -> {_list(SYLLABLES[script])}[{_B.format('i')} % {len(SYLLABLES[script])}]), '')"


#: The surrogate's normal form, from kind, norm and h.
CODE = f"""CASE kind
  WHEN 'email' THEN concat({_mask("substring_index(norm, '@', 1)", 0)}, {_MORE_LETTERS}, '@', {_mask("substring(norm, instr(norm, '@') + 1, length(norm) - instr(norm, '@') - length(substring_index(norm, '.', -1)))", 32)}, 'example')
  WHEN 'ip' THEN concat_ws('.', cast(if(attempt > 2, {_B.format('0')}, 240 + {_B.format('0')} % 15) AS string), cast({_B.format('1')} AS string), cast({_B.format('2')} AS string), cast({_B.format('3')} AS string))
  WHEN 'ssn' THEN if(attempt > 2, {_DIGITS.format('9')}, concat('9', {_DIGITS.format('8')}))
  WHEN 'phone' THEN concat(substring(norm, 1, greatest(0, length(norm) - 10)), {_DIGITS.format('least(10, length(norm))')}, {_MORE_DIGITS})
  WHEN 'card' THEN transform(array(concat(substring(norm, 1, 1), {_DIGITS.format('length(norm) - 2')}, '0')), y ->
    concat(substring(y, 1, length(y) - 1), cast(pmod({_LUHN.format('norm')} - {_LUHN.format('y')}, 10) AS string)))[0]
  ELSE concat(if(kind LIKE '%cyrillic%', {_name('cyrillic')}, {_name('latin')}),
    CASE {" ".join(f"WHEN kind LIKE '%{s}-{g}' THEN '{e}'" for s in ENDINGS for g, e in ENDINGS[s].items())} ELSE '' END)
END"""

#: Digits of code put in the place of the digits of raw; names take the case of raw.
RENDER = """CASE WHEN kind IN ('phone', 'card', 'ssn') THEN aggregate(split(raw, ''), named_struct('s', '', 'i', 1), (a, c) -> if(c RLIKE '[0-9]',
    named_struct('s', concat(a.s, substring(code, a.i, 1)), 'i', a.i + 1), named_struct('s', concat(a.s, c), 'i', a.i)), a -> concat(a.s, substring(code, a.i)))
  WHEN kind IN ('email', 'ip') THEN code WHEN raw = upper(raw) THEN upper(code) ELSE initcap(code) END"""


def _coded(table: DataFrame, secret: str) -> DataFrame:
    keyed = F.sha2(F.concat_ws("\x1f", F.lit(secret), "kind", "norm", F.col("attempt").cast("string")), 512)
    return table.withColumn("h", keyed).withColumn("code", F.expr(CODE)).select("kind", "norm", "attempt", "code")


def surrogate_map(entities: DataFrame, secret: str) -> DataFrame:
    """Distinct (kind, norm) to (kind, norm, code), codes distinct within a kind and equal to no norm of it. Only those that clash go on to
    the next attempt; as surrogates grow, each further attempt leaves a shrinking part of them."""
    spark = entities.sparkSession
    names = stage(entities.select("kind", "norm").distinct(), "names")
    settled: list[DataFrame] = []
    left, attempt = names, 0
    while True:
        now = stage(_coded(left.select("kind", "norm").withColumn("attempt", F.lit(attempt)), secret), "codes")
        used = names.select("kind", F.col("norm").alias("code"))
        for done in settled:
            used = used.unionByName(done.select("kind", "code"))
        # the few codes that are taken: an entity of the kind reads so, or an earlier attempt has it
        taken = used.join(now.select("kind", "code"), ["kind", "code"], "left_semi").distinct().withColumn("taken", F.lit(True))
        owner = now.groupBy("kind", "code").agg(F.min("norm").alias("own"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
        judged = now.join(taken, ["kind", "code"], "left").join(owner, ["kind", "code"], "left")
        judged = stage(judged.select("kind", "norm", "code", (F.col("taken").isNotNull() | (F.coalesce("own", "norm") != F.col("norm"))).alias("bad")), "codes")
        release(spark, now)
        settled.append(judged.filter("NOT bad").select("kind", "norm", "code"))
        left, attempt = judged.filter("bad"), attempt + 1
        if attempt > 100 and not left.isEmpty():
            raise ValueError("a format has too few values for surrogates that differ from its entities")
        if left.isEmpty():
            out = settled[0]
            for done in settled[1:]:
                out = out.unionByName(done)
            return out


def replace_pii(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, and n_entities (long), kinds (sorted array of the kinds found).

    Whoever knows ``secret`` can tell which surrogate an entity has: keep it out of code and logs."""
    if not secret:
        raise ValueError("a secret is needed: without one, surrogates could be derived again by anyone")

    def own(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    t = F.col(f"`{text}`")
    hinted = F.coalesce(t.rlike(HINT), F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0).alias("_")).alias("row")
    cut = docs.filter(hinted).select(row, t.alias("text")).withColumn("entities", F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).withColumn("segments", F.split("text", ANY))
    found = stage(cut.select(F.monotonically_increasing_id().alias("id"), "row", F.expr(PIECES).alias("pieces")), "pii")
    parts = found.select("id", F.posexplode("pieces").alias("pos", "piece")).select("id", "pos", "piece.*").filter("kind <> ''")
    codes = surrogate_map(parts, secret)
    rendered = parts.join(codes, ["kind", "norm"]).withColumn("new", F.expr(RENDER))
    per = rendered.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("news"))
    joined = found.join(per, "id", "left")
    new = F.when(F.col("news").isNull(), F.array_join("pieces.raw", "")).otherwise(
        F.array_join(F.transform("pieces", lambda p, i: F.coalesce(F.when(p["kind"] != "", F.element_at("news", i)), p["raw"])), "")
    )
    kinds = F.array_sort(F.array_distinct(F.transform(F.filter("pieces.kind", lambda k: k != ""), lambda k: F.substring_index(k, "-", 1))))
    n = F.size(F.filter("pieces.kind", lambda k: (k != "") & ~k.startswith("given")))
    done = joined.select(*[(new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns], n.cast("long").alias(own("n_entities")), kinds.alias(own("kinds")))
    plain = docs.filter(~hinted).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("long").alias(own("n_entities")), F.array().cast("array<string>").alias(own("kinds")))
    return done.unionByName(plain)
