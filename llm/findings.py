"""Labelled findings that train the secret forest where a corpus brings no reviewed ones.

Each finding is written into a line whose form fixes its label: secrets stand where credentials stand, look-alikes
(digests, ids, paths, numbers, placeholders, documentation keys) where those stand. Values come from SHA-256 of a row
number, so every session has the same table. No feature of the forest takes part in a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines with a secret. Braces stand for the values of ``_values``.
SECRET = (
    "{lead} password={hex18} {tail}", "{lead} token = \"{hex40}\" {tail}", "password = \"{odd}\" {tail}", "pwd='{tiny}!{tiny}'", "passwd: {odd}",
    "db_password_prod: \"{word} {nonce}\"", "passphrase = \"{word} {nonce} {word2} {nonce2}\" {tail}", "passphrase: \"{nonce} {nonce2} {word} {word2}\"",
    "PASSWORD={nonce}", "{\"secretKey\": \"{tiny}\"}", "token = b'{tiny}#{tiny}'", "{lead} password={tiny}", "my_secret_password = `{tiny}`",
    "api_key: {base64} {tail}", "export API_TOKEN={base64}", "Authorization: Bearer {base64}", "{lead} access key {base64} {tail}",
    "secret: {hex64}", "id AKIA{upper16} {tail}", "{lead} ASIA{letters16}", "gho_{alnum36} {tail}", "{lead} ghp_{alnum36}", "sk_live_{alnum24}",
    "{lead} glpat-{alnum24} {tail}", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "password={nonce}!{nonce2}", "auth_token='{hex32}'",
    "{lead} use the token {hex40} {tail}", "password={letter}", "{\"client_secret\": \"{base64}\"}", "password={digits8}",
)
#: Lines with a look-alike.
HARMLESS = (
    "{lead} {digits16} {tail}", "the card number was {digits16} {tail}", "{lead} +1 ({digits3}) 555 {digits16} {tail}", "order {digits16}, {tail}",
    "commit {hex40} {tail}", "{lead} sha256:{hex64}", "md5 {hex32}  {word}.tar.gz", "index {hex40}..{hex40b}", "ETag: \"{hex32}\"",
    "https://{word}.example.com/{word2}/{digits8}-{hex32}/{word}", "/usr/lib/{word}/{word2}/{hex40}/{word}.so", "{word}_{word2}_{word3}_{digits3}_{word}",
    "{lead} {word}-{word2}-{word3}-{digits8} {tail}", "/{word}/{word2}/{word3}{digits3}/{word}", "uuid {uuid} {tail}", "{\"id\": \"{uuid}\"}",
    "password = get_{word}() {tail}", "token = \"<your {word} token>\"", "secret = ${{word}_{word2}}", "password = ********", "token: null,",
    "api_key = \"YOUR_API_KEY\"", "{lead} secret: {word} {word2} {tail}", "The secret: {nonce} {nonce2} up on it", "{lead} token: {nonce}, {nonce2} {word} {tail}", "the password: {nonce} {nonce2}", "password: required",
    "token = {{ {word} }}", "passwd = os.environ[\"{word}\"]", "key id AKIA{upper6}407EXAMPLE {tail}", "AKIA{upper8}EXAMPLE9 {tail}",
    "password = \"example_{word}_example\"", "token=\"test_{word}_{word2}\"", "{lead} {word}{word2}{word3}{digits3} {tail}", "version {digits16}.{digits8}",
    "secret = {word}.{word2}()", "auth: false {tail}",
)
LEADS = ("", "the", "and so it is that the", "here", "it was the", "und der", "de la que", "line 7:", "#", "and onor then")
TAILS = ("", "and after it", "in the list", "so", ".", "und nicht", "de las", "by hand", "that the")
WORDS = (
    "account", "address", "article", "build", "change", "client", "config", "content", "default", "document", "download", "example",
    "header", "image", "index", "message", "method", "model", "module", "number", "object", "order", "product", "public", "query",
    "release", "report", "request", "result", "sample", "section", "server", "service", "session", "source", "string", "system", "update",
)


def _of(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _values(row: Column) -> dict[str, Column]:
    """Values by name, from digests of the row number."""
    hash_ = lambda k: F.sha2(F.concat_ws("/", F.lit(k), row.cast("string")), 256)
    number = lambda k: F.conv(F.left(hash_(k), F.lit(12)), 16, 10).cast("bigint")
    base64 = F.base64(F.unhex(hash_("b64")))
    alnum = F.translate(base64, "+/=", "q7")
    letters = F.translate(F.upper(hash_("up")), "0123456789", "GHJKLMNPQR")
    spread = F.translate(F.upper(hash_("up")), "012345678", "GXKZWMTQY")
    digits = F.lpad(F.conv(F.left(hash_("digits"), F.lit(14)), 16, 10), 17, "4")
    nonce = lambda k: F.translate(F.left(hash_(k), F.lit(7)), "0123456789", "rtmnslopvu")
    at = lambda value, start, n: F.substring(value, start, n)
    size = F.pmod(number("size"), F.lit(9))
    return {
        "lead": _of(LEADS, number("lead")), "tail": _of(TAILS, number("tail")), "word": _of(WORDS, number("w1")), "word2": _of(WORDS, number("w2")),
        "word3": _of(WORDS, number("w3")), "hex18": at(hash_("h"), 1, 18), "hex32": at(hash_("h"), 1, 32), "hex40": at(hash_("h"), 1, 40),
        "hex40b": at(hash_("g"), 1, 40), "hex64": hash_("h"), "base64": at(base64, 1, 40), "alnum36": at(alnum, 1, 36), "alnum24": at(alnum, 1, 24),
        "upper16": at(spread, 1, 16), "upper8": at(spread, 1, 8), "upper6": at(spread, 1, 6), "letters16": at(letters, 1, 16), "digits16": at(digits, 2, 16),
        "digits8": at(digits, 4, 8), "digits3": at(digits, 6, 3), "tiny": F.left(alnum, 2 + F.pmod(number("n"), F.lit(4)).cast("int")), "letter": at(nonce("l"), 1, 1),
        "odd": F.concat(F.initcap(nonce("o")), at(digits, 7, 1), F.lit("&"), F.left(alnum, size.cast("int")), at(digits, 9, 1)),
        "nonce": nonce("n1"), "nonce2": nonce("n2"),
        "uuid": F.concat_ws("-", at(hash_("u"), 1, 8), at(hash_("u"), 9, 4), at(hash_("u"), 13, 4), at(hash_("u"), 17, 4), at(hash_("u"), 21, 12)),
    }


def lines(spark: SparkSession, rows: int) -> DataFrame:
    """(doc_id, text, label): ``rows`` lines, every form equally often."""
    forms = SECRET + HARMLESS
    row = F.col("id")
    text = _of(forms, row)
    for name, value in _values(row).items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    label = (F.pmod(row, F.lit(len(forms))) < len(SECRET)).cast("double")
    return spark.range(rows).select(row.alias("doc_id"), text.alias("text"), label.alias("label"))
