"""Surrogates for personal data: keyed, type-consistent, distinct.

Entities are found by patterns: e-mail and IPv4 addresses, phone, card, social
security and bank account numbers, and names of persons (known given names, or
titles, followed by capitalised words, in Latin or Cyrillic script). Each is
reduced to a canonical form, so that spellings of one entity ("+1 (555) 010-2345"
and "+1 555 010 2345"; "Ms. Lopez" and "Maria Lopez") share it, and gets a
surrogate drawn by a keyed hash: digits for digits and letters for letters in
the same places, valid check digits (cards, bank accounts) where there were, names
of the same gender and script. The surrogate is then written in the mention's own
format.

Gender is no part of a surname's identity, so "Mrs. Maria Lopez", "Ms. Lopez" and
"Dr. Lopez" share one; Cyrillic surnames carry theirs in their ending. A given name
after a neutral title has the gender that the document gives it elsewhere. A
surname that a document introduces by title or given name is also replaced where
the document has it alone, as a capitalised word.

Collision checks: surrogates of all distinct entities of the corpus are compared
with each other and with the entities themselves. Of several entities with one
surrogate the first keeps it; the others, and those whose surrogate is somebody's
real value, draw again with the next number, until nothing collides. Later draws
are longer, one sign a draw, so the draws end however full a format's space is.
So equal entities have equal surrogates in all documents and different ones
different ones.

Only DataFrame functions are used. Texts without an entity are passed on where
they are; of the others, narrow mentions are shuffled to meet their surrogates,
and texts to meet their mentions. Distinct entities are found by partial
aggregates, so an entity with a third of all mentions is one row a task. Patterns
have no unbounded group loops (a domain has at most 127 labels of 63 signs), as
those take stack for each turn.

Defined results
- null text: null, no entities. Empty or blank texts: unchanged.
- null doc_id: treated like any other. Repeated rows: each is returned, all alike.
- an empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, forget, let, written
from tessera.llm.spans import blanked, find, replaced

KEY = "change-me"
#: Fixed patterns, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,63}+",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.+-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![\w-])|(?<![\w.+-])[0-9]{13,19}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])",
    "phone": r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])|(?<!\w)\+[0-9]{8,15}(?!\w)",
}
#: Fixed word lists: given names by gender, and titles.
FEMALE = "Mary Maria Anna Anne Emma Julia Laura Sarah Elena Sofia Lucia Marie Claire Camille Ingrid Petra Susanne Carmen Linda Patricia Jennifer Elizabeth Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана".split()
MALE = "John James Robert Michael David William Thomas Peter Paul Hans Klaus Jürgen Stefan Carlos Juan José Luis Miguel Pierre Jean Jacques François Henri George Иван Сергей Дмитрий Алексей Николай Владимир Михаил Андрей".split()
TITLES = {"f": "Mrs Ms Frau Madame Señora".split(), "m": "Mr Herr Monsieur Señor".split(), "n": "Dr Prof".split()}

CAPITAL = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_TITLE = "|".join(t for group in TITLES.values() for t in group)
_GIVEN = "|".join(FEMALE + MALE)
#: A name or title begins with a capital; this is looked at first, as it rules out most places.
BEGIN = r"(?=[A-Z\u00C0-\u00DE\u0400-\u042F])(?<![\p{L}\p{N}])"
#: A capitalised word alone.
ALONE = rf"(?=[A-Z\u00C0-\u00DE\u0400-\u042F])(?<![\p{{L}}\p{{N}}@_%+-]){CAPITAL}(?![\p{{L}}\p{{N}}@_%+])"
#: A capitalised word that is no title.
NAME = rf"(?!(?:{_TITLE})(?!\p{{L}})){CAPITAL}"
PERSON = rf"{BEGIN}(?:(?:{_TITLE})\.? (?:{NAME} )?{NAME}|(?:{_GIVEN}) {NAME})(?!\p{{L}})"
ANY = "|".join([*PATTERNS.values(), PERSON])
#: Any match implies a digit, an @, a title or a known name.
HINT = rf"[0-9@]|{BEGIN}(?:{_TITLE}|{_GIVEN})\.? "
MENTION = "array<struct<start:int,end:int,kind:string,canon:string,hit:string>>"

#: Syllables that surrogate names are made of, by script: consonants, vowels, and endings by role and gender.
SOUNDS = {
    "latin": ("bdfgklmnprstv", "aeiou", {"given:f": "a", "given:m": "n", "given:n": "el", "surname": "ard"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"given:f": "на", "given:m": "р", "given:n": "ль", "surname": "ев"}),
}
#: Draws after which digits, and letters, become more.
DIGITS_GROW, LETTERS_GROW = 8, 2


def among(x: Column, options: list[str]) -> Column:
    return x.isin(options)


def kind_of(hit: Column) -> Column:
    out = F.lit("person")
    for kind, pattern in reversed(PATTERNS.items()):
        plain = pattern.split("|(?<")[0] if kind not in ("card", "phone") else pattern
        out = F.when(hit.rlike(rf"^(?:{plain})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, hit: Column) -> Column:
    return F.when(kind == "email", ascii_lower(hit)).when(kind == "ip", hit).when(kind == "iban", F.regexp_replace(hit, " ", "")).otherwise(F.regexp_replace(hit, "[^0-9]", ""))


def name_parts(x: Column) -> Column:
    """Mentions of the names within a person's mention; titles are left as they are."""

    def of(words: Column) -> Column:
        bare = F.transform(words, lambda w: F.rtrim(w, F.lit(".")))
        has = lambda names: F.exists(bare, lambda w: among(w, names))
        gender = F.when(has(TITLES["f"]) | has(FEMALE), "f").when(has(TITLES["m"]) | has(MALE), "m").otherwise("n")
        titles = [t for group in TITLES.values() for t in group]

        def part(w: Column, i: Column) -> Column:
            start = x["start"] + F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda a, v: a + F.length(v) + 1)
            script = F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
            role = F.when(i == F.size(words) - 1, "surname").otherwise("given")
            kind = F.when((i == 0) & among(F.rtrim(w, F.lit(".")), titles), "title").when(role == "surname", F.concat_ws(":", role, script)).otherwise(F.concat_ws(":", role, gender, script))
            return F.struct(start.alias("start"), (start + F.length(w)).alias("end"), kind.alias("kind"), F.lower(w).alias("canon"), w.alias("hit"))

        return F.filter(F.transform(words, part), lambda m: m["kind"] != "title")

    return let(F.split(x["hit"], " "), of)


def mentions(text: Column) -> Column:
    """start, end, kind, canonical form and spelling of every entity, in order, without overlaps."""

    def of(x: Column) -> Column:
        one = lambda k: F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), k.alias("kind"), canonical(k, x["hit"]).alias("canon"), x["hit"].alias("hit")))
        return let(kind_of(x["hit"]), lambda k: F.when(k == "person", name_parts(x)).otherwise(one(k)))

    return F.flatten(F.transform(find(F.coalesce(text, F.lit("")), ANY, hint=HINT), of)).cast(MENTION)


def luhn(digits: Column) -> Column:
    """The sum, modulo 10, that is 0 for a number with a valid check digit."""

    def each(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), each), F.lit(0), lambda a, x: a + x) % 10


def mod97(signs: Column) -> Column:
    """A number of digits and capitals (A is 10), modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(signs, ""), F.lit(0), lambda a, c: step(a, c).cast("int"))


def drawn(kind: Column, canon: Column, turn: Column, key: str) -> Column:
    """The surrogate of a canonical form, as canonical form; ``turn`` counts the draws."""
    digest = lambda tag, what: F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"{tag}{i}"), kind, what, turn.cast("string")), 256) for i in range(2)])
    number = lambda d, i: F.conv(F.substring(d, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pick = lambda chars, n: F.substring(F.lit(chars), n % len(chars) + 1, F.lit(1))

    def like(c: Column, n: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), pick(lower, n)).when(c.rlike("[A-Z]"), pick(upper, n)).otherwise(c)

    def more(after: int, signs: str) -> Column:
        """Signs that a late draw has besides."""
        other = F.sha2(F.concat_ws("|", F.lit(key), F.lit("more"), kind, canon, turn.cast("string")), 256)
        return F.substring(F.translate(other, "0123456789abcdef", signs), F.lit(1), F.greatest(turn - after, F.lit(0)))

    more_digits, more_letters = more(DIGITS_GROW, "0123456789123456"), more(LETTERS_GROW, "abcdefghijklmnop")

    def mapped(what: Column, d: Column) -> Column:
        return F.array_join(F.transform(F.split(what, ""), lambda c, i: like(c, number(d, i))), "")

    def email(d: Column) -> Column:
        local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
        last = F.substring_index(domain, ".", -1)
        rest = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
        # a domain's surrogate depends on the domain alone
        own = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
        return F.concat(mapped(local, d), more_letters, F.lit("@"), mapped(rest, F.concat(own, own)), F.lit("."), last)

    def ip(d: Column) -> Column:
        four = F.concat_ws(".", (number(d, F.lit(0)) % 223 + 1).cast("string"), *[(number(d, F.lit(i)) % 256).cast("string") for i in (1, 2, 3)])
        return F.when(more_digits == "", four).otherwise(F.concat(four, F.lit(":"), more_digits))

    def card(d: Column) -> Column:
        body = F.concat(F.substring(canon, 1, 1), F.substring(mapped(canon, d), F.lit(2), F.length(canon) - 2), more_digits)
        check = F.when(luhn(canon) == 0, F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10))).otherwise(number(d, F.lit(31)) % 10)
        return F.concat(body, check.cast("string"))

    def phone(d: Column) -> Column:  # the country's digit and a valid first digit stay likely
        return F.concat(F.substring(canon, 1, 1), F.substring(mapped(canon, d), F.lit(2), F.length(canon)), more_digits)

    def iban(d: Column) -> Column:
        country, account = F.substring(canon, 1, 2), F.concat(F.substring(mapped(canon, d), F.lit(5), F.length(canon)), more_digits)
        right = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        valid = mod97(F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4))) == 1
        return F.concat(country, F.when(valid, right).otherwise(F.substring(mapped(canon, d), 3, 2)), account)

    def name(d: Column) -> Column:
        out = F.lit("")
        for script, (consonants, vowels, endings) in SOUNDS.items():
            syllable = lambda i, c=consonants, v=vowels: F.concat(pick(c, number(d, F.lit(2 * i))), pick(v, number(d, F.lit(2 * i + 1))))
            signs = (consonants[:8] + vowels + vowels)[:16]
            longer = more(LETTERS_GROW, signs + consonants[: 16 - len(signs)])
            first = pick(consonants, number(d, F.lit(30)))
            for role, ending in endings.items():
                stem = F.concat(syllable(0), syllable(1), *([syllable(2)] if role == "surname" else []), longer)
                close = F.concat(first, F.lit(ending)) if ending[0] in vowels else F.lit(ending)
                if role == "surname" and script == "cyrillic":  # a feminine form keeps its ending
                    close = F.concat(close, F.when(canon.rlike("[ая]$"), "а").otherwise(""))
                out = F.when(kind == f"{role}:{script}", F.concat(stem, close)).otherwise(out)
        return out

    by_kind = lambda d: (
        F.when(kind == "email", email(d))
        .when(kind == "ip", ip(d))
        .when(kind == "card", card(d))
        .when(kind == "phone", phone(d))
        .when(kind == "iban", iban(d))
        .when(kind == "ssn", F.concat(mapped(canon, d), more_digits))
        .otherwise(name(d))
    )
    return let(digest("draw", canon), by_kind)


def written_like(kind: Column, hit: Column, new: Column) -> Column:
    """The canonical surrogate in the format of a mention."""
    chars = F.split(hit, "")
    digit_at = lambda i: F.length(F.regexp_replace(F.substring(hit, F.lit(1), i + 1), "[^0-9]", ""))
    signs_at = lambda i: F.length(F.regexp_replace(F.substring(hit, F.lit(1), i + 1), " ", ""))
    rest = lambda dropped: F.substring(new, F.length(F.regexp_replace(hit, dropped, "")) + 1, F.length(new))  # noqa: E731  what a late draw has besides
    digits = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, digit_at(i), F.lit(1))).otherwise(c)), ""), rest("[^0-9]"))
    blocks = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(c != " ", F.substring(new, signs_at(i), F.lit(1))).otherwise(c)), ""), rest(" "))
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")
    return F.when((kind == "email") & (F.length(new) > F.length(hit)), new).when(kind == "email", cased).when(kind == "ip", new).when(kind == "iban", blocks).when(kind.contains(":"), F.initcap(new)).otherwise(digits)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, new) with a surrogate for each distinct entity that no other entity has, as surrogate or as its own value."""
    sort = F.when(F.col("kind").contains(":"), "name").otherwise(F.col("kind"))  # names of any role are told apart
    now, done = entities.select("kind", "canon", F.lit(0).alias("turn")), ()
    while True:
        now = written(now.withColumn("new", drawn(F.col("kind"), F.col("canon"), F.col("turn"), key)).withColumn("sort", sort), "pii-drawn")
        forget(*done)
        first = now.groupBy("sort", "new").agg(F.min(F.concat_ws("|", F.format_string("%06d", "turn"), "kind", "canon")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        real = now.select("sort", F.col("canon").alias("new")).distinct()
        late = now.join(first, ["sort", "new"]).where(F.concat_ws("|", F.format_string("%06d", "turn"), "kind", "canon") != F.col("first")).select("kind", "canon")
        taken = now.join(real, ["sort", "new"], "left_semi").select("kind", "canon")
        again = written(late.unionByName(taken).distinct().withColumn("again", F.lit(1)), "pii-again")
        if not again.take(1):
            forget(again)
            return now.select("kind", "canon", "new")
        done = now, again
        now = now.join(again, ["kind", "canon"], "left").select("kind", "canon", (F.col("turn") + F.coalesce("again", F.lit(0))).alias("turn"))


def resolved(each: DataFrame) -> DataFrame:
    """Mentions, with the gender of given names that a neutral title left open taken from the document's other mentions."""
    others = Window.partitionBy("doc_id", "tie", "canon", F.substring_index("kind", ":", -1))
    given = each.where(F.col("kind").startswith("given:"))
    given = given.withColumn("kind", F.when(F.col("kind").startswith("given:n"), F.min("kind").over(others)).otherwise(F.col("kind")))
    return each.where(~F.col("kind").startswith("given:")).unionByName(given)


def alone(some: DataFrame, each: DataFrame) -> DataFrame:
    """Mentions of surnames that the document has introduced, where they stand alone."""
    introduced = each.where(F.col("kind").startswith("surname:")).select("doc_id", "tie", "kind", "canon").distinct()
    introduced = introduced.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "kind", "canon")
    texts = some.where(F.exists("found", lambda m: m["kind"].startswith("surname:")))
    places = find(blanked(F.col("text"), F.col("found")), ALONE)
    words = texts.select("doc_id", "tie", F.explode(places).alias("m")).select("doc_id", "tie", "m.start", "m.end", "m.hit", F.lower("m.hit").alias("low"))
    both = words.join(introduced, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")) & (F.col("low") == F.col("canon")))
    return both.select("doc_id", "tie", "start", "end", "kind", "canon", "hit").distinct()


def replaced_texts(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with every entity replaced, and n_entities of every document."""
    read = docs.select("doc_id", "text", mentions(F.col("text")).alias("found"))
    clean = read.where(F.size("found") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    some = written(read.where(F.size("found") > 0).withColumn("tie", F.xxhash64("text")), "pii-texts")
    each = some.select("doc_id", "tie", F.explode("found").alias("m")).select("doc_id", "tie", "m.*").distinct()
    each = written(resolved(each).unionByName(alone(some, each)), "pii-mentions")
    new = assigned(each.select("kind", "canon").distinct(), key)
    told = each.join(new, ["kind", "canon"]).withColumn("new", written_like(F.col("kind"), F.col("hit"), F.col("new")))
    told = told.groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "new"))).alias("at"))
    both = some.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    changed = both.select("doc_id", replaced(F.col("text"), F.col("at")).alias("text"), F.size("at").cast("long").alias("n_entities"))
    return clean.unionByName(changed)
