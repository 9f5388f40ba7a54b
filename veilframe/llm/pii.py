"""Personal data in free text: a semi-Markov conditional random field over candidate segments.

Candidates are whole spans: shapes of e-mail addresses, phone numbers, identity numbers, street
addresses and full names, with all their possible boundaries (with and without flat, house-number letter,
middle initial, ...).  Every span is described as a whole (shape, checksum, lexicons, cue words on both
sides, whether it could be longer); the weights are learned by conditional likelihood over all sets of
non-overlapping spans, and dynamic programming over bounded spans picks boundaries and kinds jointly.

The training texts are composed here from public formats, own vocabulary and invented words, so most of the weight
lies on the spans themselves; the lexicons of given and family names grow from all of the texts.  A pair of
words that no lexicon holds is a candidate too, which the model judges by its cues and by whether the words are also
written small.  Identity numbers must satisfy their scheme's check, which the library states.  Names in Cyrillic and
Greek are found by case; in Han, Hangul, Arabic, Hebrew, Devanagari and Thai script by a label, title or
form of address beside them, as these scripts don't mark names.

Spans count code points of the original text; full-width characters, odd blanks and invisible
characters are folded for matching and mapped back.  A null text has no finding and stays null; repeated
rows count once; texts are taken whole.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.checks import CHECKS
from veilframe.session import by_key, cut

KINDS = ("email", "phone", "id_number", "street_address", "name")

# ---------------------------------------------------------------------------------------- folding
INVISIBLE = set("\u00ad\u200b\u200c\u200d\u2060\ufeff\u200e\u200f")
FOLD = {0xFF01 + i: 0x21 + i for i in range(94)} | {ord(c): " " for c in "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"} | {ord("‐"): "-", ord("‑"): "-", ord("–"): "-", ord("−"): "-"}


FOLDED = {chr(c) for c in FOLD}


def folded(text: str) -> tuple[str, list[int] | None]:
    """(text for matching, original place of each of its characters or None for the identity)."""
    if text.isascii():
        return text, None
    used = set(text)
    plain = text.translate(FOLD) if FOLDED & used else text
    if not INVISIBLE & used:
        return plain, None
    keep = [i for i, c in enumerate(plain) if c not in INVISIBLE]
    return "".join(plain[i] for i in keep), keep


# ------------------------------------------------------------------------------ identity numbers
def digits(s: str) -> list[int]:
    return [int(c) for c in s if c.isdigit()]


def checked(name: str) -> Callable[[str], bool]:
    """The library's check of a number without its separators, letters in capitals."""
    check = CHECKS[name]
    return lambda s: check(re.sub(r"[^0-9A-Za-z]", "", s).upper())


def is_sin(s: str) -> bool:
    """Also numbers that begin with 0, which are kept for examples."""
    d = digits(s)
    return len(d) == 9 and d[0] != 8 and len(set(d)) > 1 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def is_nino(s: str) -> bool:
    raw = re.sub(r"\W", "", s).upper()
    return raw[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ") and raw[0] not in "DFIQUV" and raw[1] not in "DFIOQUV"


def is_steuer(s: str) -> bool:
    return s[0] != "0" and len(digits(s)) == 11 and CHECKS["Germany Tax ID"](s)


def is_bsn(s: str) -> bool:
    return len(digits(s)) == 9 and len(set(digits(s))) > 1 and CHECKS["Netherlands BSN"](s)


is_dni, is_ssn = checked("Spain DNI"), checked("USA SSN")

EDGE_L, EDGE_R = r"(?<![\w+])(?<![\d][.,/-])", r"(?![\w])(?![-/.]\d)"
#: (scheme, shape, check, words that name the scheme)
SCHEMES = [
    ("ssn", r"\d{3}([- .])\d{2}\1\d{4}", is_ssn, r"SSN|social security"),
    ("ssn", r"\d{9}", is_ssn, r"SSN|social security"),
    ("sin", r"\d{3}[- ]?\d{3}[- ]?\d{3}", is_sin, r"SIN|social insurance|NAS"),
    ("bsn", r"\d{9}|\d{4}\.\d{2}\.\d{3}|\d{3} \d{3} \d{3}", is_bsn, r"BSN|burgerservice\w*"),
    ("nhs", r"\d{3}[- ]\d{3}[- ]\d{4}|\d{10}", checked("British NHS"), r"NHS"),
    ("nir", r"[1278][ .]?\d\d[ .]?\d\d[ .]?\d[\dAB][ .]?\d{3}[ .]?\d{3}[ .-]?\d\d", checked("France NIR"), r"NIR|INSEE|sécurité sociale|NSS"),
    ("pesel", r"\d{11}", checked("Poland PESEL"), r"PESEL"),
    ("dni", r"(?:\d{8}|[XYZ][- ]?\d{7})[- ]?[A-Za-z]", is_dni, r"DNI|NIE|NIF"),
    ("cpf", r"\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11}", checked("Brazil CPF"), r"CPF"),
    ("codice", r"[A-Za-z]{6}\d{2}[A-Za-z]\d{2}[A-Za-z]\d{3}[A-Za-z]", checked("Italy Codice Fiscale"), r"codice fiscale|CF"),
    ("nino", r"[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]", is_nino, r"NINO|national insurance"),
    ("steuer", r"\d{2} ?\d{3} ?\d{3} ?\d{3}", is_steuer, r"Steuer-?ID|IdNr|Steueridentifikationsnummer"),
    ("nrn", r"\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}|\d{11}", checked("Belgium NRN"), r"NRN|rijksregisternummer|numéro national"),
    ("aadhaar", r"\d{4} \d{4} \d{4}|\d{12}", checked("India Aadhaar"), r"Aadhaar"),
    ("nric", r"[STFG]\d{7}[A-Z]", checked("Singapore NRIC"), r"NRIC|FIN"),
    ("rrn", r"\d{6}-\d{7}|\d{13}", checked("South Korea RRN"), r"RRN|주민등록번호"),
    ("curp", r"[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z\d]\d", checked("Mexico CURP"), r"CURP"),
    ("personnummer", r"\d{6}[-+]\d{4}|\d{10}", checked("Sweden PIN"), r"personnummer|pnr"),
    ("cpr", r"\d{6}-\d{4}|\d{10}", checked("Denmark CPR"), r"CPR(?:-nummer)?"),
    ("resident", r"\d{17}[\dXx]", checked("China Resident ID"), r"身份证(?:号码?)?|resident ID"),
    ("hkid", r"[A-Z]{1,2}\d{6}\([\dA]\)", checked("Hong Kong ID"), r"HKID|身份證(?:號碼?)?"),
    ("my number", r"\d{4}[ -]\d{4}[ -]\d{4}|\d{12}", checked("Japan My Number"), r"マイナンバー|個人番号|My Number"),
    ("teudat", r"\d{9}", checked("Israel Teudat Zehut"), r"Teudat Zehut|ת\.?ז\.?|תעודת זהות"),
    ("za", r"\d{13}|\d{6} \d{4} \d{3}", checked("South Africa ID"), r"SA ID|South African ID"),
    ("cuil", r"\d{2}-\d{8}-\d|\d{11}", checked("Argentina CUIL/CUIT"), r"CUIL|CUIT"),
    ("rut", r"\d{1,2}\.\d{3}\.\d{3}-[\dKk]|\d{7,8}-[\dKk]", checked("Chile RUN/RUT"), r"RUT|RUN"),
    ("medicare", r"\d{4} \d{5} \d(?: ?\d)?|\d{10,11}", checked("Australia Medicare"), r"Medicare(?: card)?"),
    ("tfn", r"\d{3} \d{3} \d{3}|\d{9}", checked("Australia TFN"), r"TFN|tax file"),
    ("emirates", r"784-\d{4}-\d{7}-\d|784\d{12}", checked("UAE Emirates ID"), r"Emirates ID"),
    ("ramq", r"[A-Z]{4} ?\d{4} ?\d{4}", checked("Quebec HC"), r"RAMQ|NAM"),
]
NAMED = {"nric", "curp", "resident", "hkid", "emirates", "nir", "dni", "codice"}  # forms that tell the scheme by themselves
CUE_TAIL = r"(?: ?(?:No|Nr|n)\b\.?[º°]?)?[ .:：#=(\t|;-]*$"
SCHEME_SHAPES = [(name, re.compile(EDGE_L + "(?:" + shape + ")" + EDGE_R), check, re.compile(r"(?i:(?<!\w)(?:" + cue + r")(?!\w))" + CUE_TAIL)) for name, shape, check, cue in SCHEMES]
ANY_SCHEME = re.compile(r"(?i:(?<!\w)(?:" + "|".join(dict.fromkeys(c for *_, c in SCHEMES)) + r")(?!\w))" + CUE_TAIL)

# ------------------------------------------------------------------------------------ other shapes
AT = r"(?: ?@ ?| ?[(\[{] ?(?:at|a|@) ?[)\]}] ?| (?:at|AT) )"
DOT = r"(?:\.| ?[(\[{] ?(?:dot|\.|punkt|punto|point) ?[)\]}] ?| (?:dot|DOT) )"
EMAIL = re.compile(r"(?i:(?<![\w.+%-])[a-z0-9](?:[\w%+'-]|\.(?=\w))*" + AT + r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:" + DOT + r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*" + DOT + r"[a-z]{2,24}(?![\w@]))")
MAYBE_EMAIL = re.compile(r"(?i)@|[(\[{] ?(?:at|a) ?[)\]}]| at (?=[\w-]+(?:\.\w| ?[(\[{]| dot ))")
STEP = re.compile(r"[\s,]")
PHONES = [
    ("intl", re.compile(r"(?<![\w+])(?<!\d[.,/-])(?:\+|00)[ ]?[1-9]\d{0,2}(?:[ .\-/]?\(0?\d{0,4}\))?(?:[ .\-/]?\d{1,5}){1,6}(?![\w])(?![-/.]\d)")),
    ("nanp", re.compile(r"(?<![\w+.,/-])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w])(?![-/.]\d)")),
    ("trunk", re.compile(r"(?<![\w+.,/-])\(?0\d{1,5}\)?(?:[ ./-]?\d{2,8}){1,5}(?![\w])(?![-/.]\d)")),
]
DATE_LIKE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2}|(?:\d{1,3}\.){3}\d{1,3}")
UP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪİĶŁĻŃŇŌŐŒŘŚŞŠŢŤŪŮŰŹŻŽȘȚ]"
CYR, GRE = r"[А-ЯЁІЇЄҐ][а-яёіїєґ]+(?:-[А-ЯЁІЇЄҐ][а-яёіїєґ]+)?", r"[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰς]+"
WORD = rf"{UP}[\w'’]*(?:-{UP}[\w'’]*)*"
ROADS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Close|Row|Way|Court|Ct|Place|Pl|Crescent|Cres|Terrace|Square|Sq|Grove|Walk|Mews|Boulevard|Blvd|Gardens|Parade"
ADDRESSES = [
    ("en", re.compile(rf"(?<![\w.,/-])(?:(?P<flat>(?i:Flat|Apt\.?|Apartment|Suite) \d{{1,4}}[A-Za-z]?, ?))?\d{{1,5}}[A-Za-z]? (?!The )(?:{WORD} ){{1,3}}(?:{ROADS}|{ROADS.upper()})(?!\w)")),
    ("de", re.compile(rf"(?<!\w)(?:{UP}[\w-]*(?:straße|strasse|str\.|weg|gasse|allee|stieg|steig|platz|ufer|damm|ring|pfad|STRASSE|STRAßE|STRAẞE|WEG|GASSE|ALLEE|STIEG|STEIG|PLATZ|UFER|DAMM|RING)|{WORD} (?:Straße|Weg|Allee|Gasse|Platz)) \d{{1,4}}(?P<tail> ?[A-Za-z](?!\w))?(?!\w)")),
    ("nl", re.compile(rf"(?<!\w){UP}\w*(?:straat|laan|plein|gracht|kade) \d{{1,4}}(?P<tail> ?[A-Za-z](?!\w))?(?!\w)")),
    ("fr", re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?: ?(?:bis|ter|quater|BIS|TER))?,? (?i:rue|avenue|av\.|impasse|allée|boulevard|bd|passage|chemin|place|quai|cours|route|sentier|square)(?: (?i:de la|de l’|de l'|des|du|de|d’|d'|aux|au))?(?: ?{WORD}){{1,4}}")),
    ("es", re.compile(rf"(?<!\w)(?i:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Ronda|Carrer|Travesía|Rua|Praça|Travessa|Via|Viale|Piazza|Corso|Largo)(?: (?i:del|de la|de las|de los|de|do|da|dos|das|della|dei|delle))?(?: {WORD}){{1,4}},? (?:n\.? ?[º°] ?|núm\. ?|no\. ?)?\d{{1,4}}(?P<tail> ?[A-Za-z](?!\w))?(?!\w)")),
]
ADDRESSES += [
    ("pl", re.compile(rf"(?<!\w)(?:ul|al|pl|os)\. ?(?:{WORD} ){{1,3}}\d{{1,4}}[A-Za-z]?(?:/\d{{1,4}})?(?!\w)")),
    ("tr", re.compile(rf"(?<!\w)(?:{WORD} ){{1,3}}(?:Sokak|Sokağı|Caddesi|Cad\.|Sok\.|Bulvarı),? (?:No: ?)?\d{{1,4}}(?!\w)")),
]
OTHER_ADDRESSES = [
    ("ru", re.compile(rf"(?<!\w)(?:(?:ул\.|улица|пр\.|пр-т|проспект|пер\.|переулок|пл\.|площадь|бульвар|наб\.|набережная|шоссе) ?(?:{CYR},? ){{1,3}}|(?:{CYR} ){{1,2}}(?:улица|проспект|переулок|бульвар|набережная|шоссе),? )(?:д\. ?|дом )?\d{{1,4}}[а-я]?(?:,? (?:корп\.|к\.|стр\.) ?\d{{1,3}})?(?P<flat>,? (?:кв\.|квартира|оф\.) ?\d{{1,4}})?(?!\w)")),
    ("el", re.compile(rf"(?<!\w)(?i:οδός|λεωφόρος|λεωφ\.|πλατεία) (?:{GRE} ){{1,3}}\d{{1,4}}(?!\w)")),
    ("zh", re.compile(r"(?:(?<![\u4e00-\u9fff])|(?<=[在于到至住区市县省寄]))(?:(?![在于到至住])[\u4e00-\u9fff]){2,4}(?:大道|路|街|巷|胡同|弄)\d{1,5}(?:号|號)(?P<flat>\d{1,4}(?:室|单元|樓|楼))?")),
    ("ja", re.compile(r"(?:(?<![\u4e00-\u9fff\u3040-\u30ff])|(?<=[都道府県市区町村はにで]))[\u4e00-\u9fff\u3040-\u30ff]{2,6}(?:\d{1,2}丁目\d{1,3}番(?:地)?(?:\d{1,3}号)?|\d{1,3}-\d{1,3}-\d{1,4})(?![\d-])")),
    ("ko", re.compile(r"[가-힣]{1,8}(?:대로|로|길) ?\d{1,4}(?:-\d{1,3})?(?:번길 ?\d{1,3})?(?!\w)")),
    ("ar", re.compile(r"شارع (?:[\u0620-\u064a]+ ){1,3}\d{1,4}(?!\w)")),
    ("hi", re.compile(r"\d{1,4},? (?:[\u0900-\u097f]+ ){1,3}(?:मार्ग|रोड|गली|सड़क)(?!\w)")),
    ("th", re.compile(r"\d{1,4}(?:/\d{1,4})? (?:ถนน|ซอย) ?[\u0e00-\u0e7f]+(?: \d{1,3})?")),
    ("he", re.compile(r"(?:רחוב|רח'|שדרות) (?:[\u05d0-\u05ea]+ ){1,3}\d{1,4}(?!\w)")),
]
#: Common given and family names by script; words before and after that tell a name.
NATIVE = {
    "cyrillic": ("Иван Мария Анна Дмитрий Сергей Ольга Наталья Елена Алексей Андрей Татьяна Михаил Владимир Екатерина Павел Николай Светлана Юлия Олександр Оксана".split(), "Иванов Петрова Смирнов Кузнецова Попов Васильев Соколова Михайлов Новиков Фёдорова Морозов Шевченко Коваленко".split()),
    "greek": ("Γιώργος Μαρία Ελένη Νίκος Κώστας Γιάννης Δημήτρης Κατερίνα Σοφία Άννα Βασιλική Παναγιώτης".split(), "Παπαδόπουλος Γεωργίου Νικολάου Παπαδάκη Οικονόμου Ιωάννου Δημητρίου".split()),
    "han": (list("伟芳娜敏静强磊军洋勇艳杰涛明超霞平刚") + "美咲 翔太 健一 花子 太郎 陽子 直樹 由美 志明 淑芬".split(), "王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 林 郭 何 罗 梁 佐藤 鈴木 高橋 田中 渡辺 伊藤 山本 中村 小林 加藤 吉田 山田 佐々木 松本 井上 木村 清水 陳 張 劉 黃".split()),
    "hangul": ("민수 지영 서연 민준 현우 은지 수빈 영희 철수 지훈".split(), list("김이박최정강조윤장임한오서신권황안송홍")),
    "arabic": ("محمد أحمد فاطمة علي خالد ليلى سارة يوسف مريم عمر".split(), "الحسن العلي حداد منصور السيد خوري الشامي ناصر".split()),
    "hebrew": ("דוד שרה יוסף רחל משה נועה אורי תמר".split(), "כהן לוי מזרחי פרץ ביטון אברהם".split()),
    "devanagari": ("राहुल प्रिया अमित सुनीता राजेश अंजलि विजय पूजा".split(), "शर्मा वर्मा सिंह गुप्ता पटेल कुमार यादव".split()),
    "thai": ("สมชาย สมหญิง วิชัย มาลี อนันต์ สุดา".split(), "ใจดี สุขสันต์ ทองดี รักไทย ศรีสุข".split()),
}
LABELS = r"(?:姓名|氏名|名前|联系人|聯絡人|担当者?|이름|성명|담당자|الاسم|اسم|שם|नाम|ชื่อ|Имя|ФИО|Ф\.И\.О\.|Όνομα|Ονοματεπώνυμο)[:： ]{1,2}"
TITLES = r"(?:السيدة|السيد|الأستاذة|الأستاذ|الدكتورة|الدكتور|מר|גב'|ד\"ר|श्रीमती|श्री|डॉ\.?|นางสาว|นาย|นาง|คุณ|г-н|г-жа|κ\.|κα)"
CUED = re.compile(rf"(?:({LABELS})|({TITLES}) ?)$")
ANY_CUE = re.compile(f"{LABELS}|{TITLES}")
HAN_CUE = re.compile("[名者当人][：:]|先生|女士|小姐|さん|様|氏")
CUED_SCRIPTS = ("arabic", "hebrew", "devanagari", "thai")  # without case, a name is told by what stands before it
HONOURED = r"(?= ?(?:先生|女士|小姐|さん|様|氏(?!名)|씨|님))"
OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0400-\u04ff\u0590-\u05ff\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")
#: Letters without which a text has no name or address of a script: an initial of a name, a letter of the script.
LETTERS = {
    "cyrillic": re.compile("[А-ЯЁІЇЄҐ][а-яёіїєґ]|ул\\."), "greek": re.compile("[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώ]"), "han": re.compile("[\u4e00-\u9fff]"), "hangul": re.compile("[가-힣]"), "arabic": re.compile("[\u0620-\u064a]"), "hebrew": re.compile("[\u05d0-\u05ea]"), "devanagari": re.compile("[\u0900-\u097f]"), "thai": re.compile("[\u0e01-\u0e4e]"),
}
ADDRESS_SCRIPT = {"ru": "cyrillic", "el": "greek", "zh": "han", "ja": "han", "ko": "hangul", "ar": "arabic", "hi": "devanagari", "th": "thai", "he": "hebrew"}
PATRONYMIC = re.compile(r"(?:ович|евич|ьич|овна|евна|ична|овича|евича|овне|евне|овны|евны)$")
OTHER_NAMES = [
    ("cyrillic", re.compile(rf"(?<!\w){CYR} {CYR}(?: {CYR})?(?!\w)")),
    ("greek", re.compile(rf"(?<!\w){GRE} {GRE}(?!\w)")),
    ("han", re.compile(rf"(?:(?<=名：)|(?<=名:)|(?<=者：)|(?<=者:)|(?<=当：)|(?<=人：)|(?<=人:))[\u4e00-\u9fff々]{{1,3}} ?[\u4e00-\u9fff\u3040-\u309f]{{1,3}}(?![\u4e00-\u9fff])|(?:{'|'.join(NATIVE['han'][1])}) ?[\u4e00-\u9fff]{{1,2}}{HONOURED}")),
    ("hangul", re.compile(rf"(?<![가-힣])[{''.join(NATIVE['hangul'][1])}] ?[가-힣]{{2}}(?:(?![가-힣])|{HONOURED})")),
    ("arabic", re.compile(r"(?<!\w)[\u0620-\u064a]{2,} [\u0620-\u064a]{2,}(?: [\u0620-\u064a]{2,})?(?!\w)")),
    ("hebrew", re.compile(r"(?<!\w)[\u05d0-\u05ea]{2,} [\u05d0-\u05ea]{2,}(?!\w)")),
    ("devanagari", re.compile(r"(?<![\u0900-\u097f])[\u0900-\u097f]{2,} [\u0900-\u097f]{2,}(?![\u0900-\u097f])")),
    ("thai", re.compile(r"[\u0e01-\u0e4e]{2,} [\u0e01-\u0e4e]{2,}")),
]
NATIVE_GIVEN = {script: frozenset(g[: max(2, len(g) - 1)] if script in ("cyrillic", "greek") else g for g in given) for script, (given, _) in NATIVE.items()}
NATIVE_FAMILY = {script: frozenset(f[: max(2, len(f) - 2)] if script in ("cyrillic", "greek") else f for f in family) for script, (_, family) in NATIVE.items()}


def native(script: str, word: str, held: dict[str, frozenset[str]]) -> bool:
    """Whether a word is in the list of its script; endings of cases are left out."""
    if script in ("cyrillic", "greek"):
        return any(word[:n] in held[script] for n in range(2, len(word) + 1))
    return word in held[script]


#: Common given names of several countries, the seed of the lexicon.
GIVEN = frozenset(
    "Alice Anna Bruno Carla Clara Daniel David Elif Emma Felix Greta Helen Hugo Ines Ivan Jonas Julia Karim Laura Lena Marco Maria Marta Mateo Nadia Nora Omar Oscar Paula Pavel Peter Ravi Rosa Samuel Simon Sofia Tomas Viktor Wanda Yuki "
    "James Mary John Robert Michael William Linda Elizabeth Richard Susan Thomas Sarah Charles Karen Christopher Lisa Nancy Matthew Anthony Mark Paul Steven Andrew Joshua George Edward Ahmed Fatima Mohamed Layla Hans Klaus Jürgen Petra Sabine Stefan Jean Pierre Marie Luc Claire Sophie José Juan Carmen Pablo Ana Luis João Pedro Giulia Luca Francesca Anders Lars Ingrid Olga Dmitri Natalia Wei Ming Hiroshi Akira Priya Arjun".split()
)
PARTICLES = r"(?:(?:van|von|de|der|den|la|del|di|da|dos|bin|al|el|Van|Von|De)[ ]){0,2}"
TOKEN = re.compile(rf"(?<![\w@.+-]){UP}[^\W\d_]+(?:['’]{UP}[^\W\d_]+)?(?:-{UP}[^\W\d_]+)*(?![\w@])")
FULL = re.compile(rf"(?<![\w@.+-])({UP}[^\W\d_]+(?:-{UP}[^\W\d_]+)*)((?: {UP}\.){{0,2}}) ({PARTICLES}{UP}[^\W\d_]+(?:['’]{UP}[^\W\d_]+)?(?:-{UP}[^\W\d_]+)*)(?![\w@])")
SHOUTED = re.compile(rf"(?<!\w){UP}{{2,}}(?![^\W\d_])[^.!?|;\t\n]*$")  # a word in capitals before, in the same sentence
LOWER = re.compile(r"(?<![\w@.+-])[a-zà-ÿ]{2,}(?![\w@])")
COUNTED = re.compile(rf"({UP}[a-zà-ÿ]+) \d")
LISTED = re.compile(rf"(?<![\w@.+-])({PARTICLES}{UP}[^\W\d_]+(?:-{UP}[^\W\d_]+)*), ?({UP}[^\W\d_]+(?:-{UP}[^\W\d_]+)*)((?: {UP}\.){{0,2}})(?![\w@])")


def overlapping(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches, also those that begin inside another one at a later word."""
    at = 0
    while m := pattern.search(text, at):
        yield m
        step = STEP.search(text, m.start() + 1)
        at = step.start() if step and step.start() < m.end() else m.end()


CLUSTER = re.compile(r"\d(?:[ .\-/()]{0,3}\d){6,}")
LETTERED = ("codice", "nino", "curp", "hkid", "ramq")  # schemes with fewer than seven digits in a row
MARGIN = 16
#: Whether any scheme's shape stands in a stretch, before the schemes are tried one by one.
ANY_NUMBER = re.compile(EDGE_L + "(?:" + "|".join(dict.fromkeys(re.sub(r"\([- .]+\)|\(\[- \.\]\)", "[- .]", shape).replace(r"\1", "[- .]") for name, shape, *_ in SCHEMES if name not in LETTERED)) + ")" + EDGE_R)
ANY_LETTERED = re.compile(EDGE_L + "(?:" + "|".join(shape for name, shape, *_ in SCHEMES if name in LETTERED) + ")" + EDGE_R)
#: Parts of road names, one of which an address of that writing has; the shapes spell them out.
ROAD_PARTS = {
    "de": "straße strasse str. weg gasse allee stieg steig platz ufer damm ring pfad".split(),
    "nl": "straat laan plein gracht kade".split(),
    "fr": "rue avenue av. impasse allée boulevard bd passage chemin place quai cours route sentier square".split(),
    "pl": ["ul.", "al.", "pl.", "os."],
    "tr": ["sok", "cad", "bulvar"],
    "es": "calle avenida avda plaza paseo camino ronda carrer travesía rua praça travessa via viale piazza corso largo".split(),
}


def clusters(text: str) -> list[tuple[int, int]]:
    """Stretches around seven or more digits with separators: every phone and every number of a scheme that isn't ``LETTERED`` lies in one."""
    out: list[tuple[int, int]] = []
    for m in CLUSTER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def left_words(text: str, at: int) -> list[str]:
    return re.findall(r"[^\W\d_]+|[|;\t(:#]", text[max(0, at - 40) : at])[-2:]


def around(kind: str, text: str, a: int, b: int) -> list[str]:
    words = left_words(text, a)
    left = words[-1].lower() if words else "^"
    two = " ".join(w.lower() for w in words)
    right = re.match(r"[ ]?([^\W\d_]+|[^\w\s]|\s)", text[b : b + 20])
    return [f"{kind}:l={left}", f"{kind}:ll={two}", f"{kind}:r={right.group(1).lower() if right else '$'}"]


Segment = tuple[int, int, str, list[str]]


class Lexicon:
    def __init__(self, given: frozenset[str] | set[str], family: frozenset[str] | set[str], common: frozenset[str] | set[str] = frozenset()) -> None:
        self.given, self.family, self.common = frozenset(given), frozenset(family), frozenset(common)

    def has_given(self, word: str) -> bool:
        return all(part.title() in self.given for part in word.split("-"))

    def has_family(self, word: str) -> bool:
        last = word.split(" ")[-1]
        return all(part.title() in self.family for part in last.split("-"))

    def known(self, given: str, family: str) -> tuple[bool, bool] | str:
        """Which part the lexicons hold; where they hold none, which part is an everyday word."""
        known = self.has_given(given), self.has_family(family)
        return known if any(known) else "none," + ",".join(str(any(part in self.common for part in re.split("[ -]", x.lower()))) for x in (given, family))


def segments(text: str, lexicon: Lexicon) -> list[Segment]:
    """All candidate spans of a folded text with their features."""
    out: list[Segment] = []

    def add(kind: str, a: int, b: int, fs: list[str]) -> None:
        out.append((a, b, kind, [f"{kind}", *(f"{kind}:{f}" for f in fs), *around(kind, text, a, b)]))

    if MAYBE_EMAIL.search(text):
        for m in EMAIL.finditer(text):
            s = m.group()
            style = "@" if "@" in s and " " not in s else "spaced" if "@" in s else "bracketed" if re.search(r"[(\[{]", s) else "words"
            add("email", m.start(), m.end(), ["style=" + style])
    if any(c.isdigit() for c in text):
        places = clusters(text)
        numbered = [(a, b) for a, b in places if ANY_NUMBER.search(text, a, b)]
        lettered = ANY_LETTERED.search(text) is not None
        for name, shape, check, cue in SCHEME_SHAPES:
            if name in LETTERED:
                matches = shape.finditer(text) if lettered else ()
            else:
                matches = (m for a, b in numbered for m in shape.finditer(text, a, b))
            for m in matches:
                if check(m.group()):
                    before = text[max(0, m.start() - 40) : m.start()]
                    own = bool(cue.search(before))
                    named = "own" if own else "other" if ANY_SCHEME.search(before) else "none"
                    form = "plain" if m.group().isdigit() else "grouped"
                    add("id_number", m.start(), m.end(), [f"named={named}", f"named,form={named},{form}", f"{name},{named},{form}"])
        for name, shape in PHONES:
            for m in (m for a, b in places for m in shape.finditer(text, a, b)):
                s = m.group()
                n = sum(c.isdigit() for c in s)
                if not 8 <= n <= 15 or DATE_LIKE.fullmatch(s) or len(set(re.sub(r"\D", "", s))) < 3:
                    continue
                before = text[max(0, m.start() - 40) : m.start()]
                named = "scheme" if ANY_SCHEME.search(before) else "none"
                form = re.sub(r"\d+", "9", s)
                inside = bool(re.search(r"\d[ .-]$", text[max(0, m.start() - 2) : m.start()]))
                add("phone", m.start(), m.end(), ["shape=" + name, "form=" + form, "n=" + str(n), "named=" + named, f"inside,named={inside},{named}", f"inside={inside}"])
        low = text.lower()
        for name, shape in ADDRESSES:
            if name in ROAD_PARTS and not [x for x in ROAD_PARTS[name] if x in low]:
                continue
            for m in overlapping(shape, text):
                a, b = m.span()
                # the name of a road doesn't reach over another house number or the name of a place before it
                tail = m.groupdict().get("tail")
                flat = re.search(r"(?i)(?:flat|apt\.?|apartment|suite) \d{1,4}[a-z]?, ?$", text[max(0, a - 24) : a])
                add("street_address", a, b, ["shape=" + name, "flat=" + ("in" if m.groupdict().get("flat") else "left out" if flat else "none"), "tail=" + ("in" if tail else "none")])
                if tail:
                    add("street_address", a, b - len(tail), ["shape=" + name, "flat=none", "tail=left out"])
    for m in overlapping(FULL, text):
        given, middle, family = m.groups()
        known = lexicon.known(given, family)
        case = "upper" if given.isupper() and family.isupper() else "mixed" if given.isupper() != family.isupper() else "title"
        if case == "upper" and SHOUTED.search(text[max(0, m.start() - 24) : m.start()]):
            case = "shouted"
        add("name", m.start(), m.end(), [f"known={known}", f"known,case={known},{case}", "middle=" + str(bool(middle)), "order=given"])
    for m in overlapping(LISTED, text):
        family, given, middle = m.groups()
        known = lexicon.known(given, family)
        case = "upper" if given.isupper() and family.isupper() else "mixed" if given.isupper() != family.isupper() else "title"
        if case == "upper" and SHOUTED.search(text[max(0, m.start() - 24) : m.start()]):
            case = "shouted"
        longer = bool(re.match(rf" {UP}\.(?!\w)", text[m.end() : m.end() + 4]))
        small = family[0].islower()
        add("name", m.start(), m.end(), [f"known={known}", f"listed known,case={known},{case}", f"listed particle={small}", "middle=" + ("left out" if longer else str(bool(middle))), "order=family"])
    if OTHER_SCRIPT.search(text):
        other_scripts(text, add)
    return sorted(out, key=lambda s: (s[1], s[0]))


def other_scripts(text: str, add: Callable[[str, int, int, list[str]], None]) -> None:
    """Candidates written in other scripts than Latin: addresses by their road words, names by lists, case and the words around them."""
    there = {script for script, letters in LETTERS.items() if letters.search(text)}
    for name, shape in OTHER_ADDRESSES:
        for m in shape.finditer(text) if ADDRESS_SCRIPT[name] in there else ():
            add("street_address", m.start(), m.end(), ["shape=" + name, "native"])
    for script, shape in OTHER_NAMES:
        for m in shape.finditer(text) if script in there and (script not in CUED_SCRIPTS or ANY_CUE.search(text)) and (script != "han" or HAN_CUE.search(text)) else ():
            a, b = m.span()
            words = m.group().split(" ")
            cue = CUED.search(text[max(0, a - 16) : a])
            if script in CUED_SCRIPTS and not cue:
                inner = re.match(TITLES + " ?", m.group())  # the title is a word or stands before without a blank
                if not inner:
                    continue
                a += inner.end()
                words, cue = text[a:b].split(" "), inner
            if not 1 <= len(words) <= 3 or (len(words) < 2 and script not in ("han", "hangul")):
                continue
            told = "none" if not cue else "label" if cue.re is CUED and cue.group(1) else "title"
            if script in ("han", "hangul"):
                told = "label" if text[max(0, a - 1) : a] in ("：", ":") else "title" if re.match(HONOURED, text[b : b + 4]) else told
                add("name", a, b, [f"native={script},{told}"])
                continue
            given = sum(native(script, w, NATIVE_GIVEN) for w in words)
            family = sum(native(script, w, NATIVE_FAMILY) for w in words)
            fathers = sum(bool(PATRONYMIC.search(w)) for w in words)
            known = f"{min(given, 1)}{min(family, 1)}{min(fathers, 1)}"
            for n in {2, len(words)}:
                end = a + len(" ".join(words[:n]))
                cut_short = n < len(words)
                add("name", a, end, [f"native={script in ('cyrillic', 'greek')},{told},{known}", f"native words={n},{cut_short},{min(fathers, 1)},{script in ('cyrillic', 'greek')}"])


def decode(found: list[Segment], weights: dict[str, float]) -> list[Segment]:
    """Best set of non-overlapping segments (semi-Markov Viterbi over the candidates' ends)."""
    best, back = [0.0], [(-1, -1)]
    ends = [s[1] for s in found]
    score = [sum(weights.get(f, 0.0) for f in s[3]) for s in found]
    for i, (a, _, _, _) in enumerate(found):
        lo, hi = 0, i
        while lo < hi:  # number of segments that end at or before the beginning of this one
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid] <= a else (lo, mid)
        take = best[lo] + score[i]
        if take > best[i]:
            best.append(take)
            back.append((i, lo))
        else:
            best.append(best[i])
            back.append((-1, i))
    out, at = [], len(found)
    while at > 0:
        i, to = back[at]
        if i >= 0:
            out.append(found[i])
        at = to
    return out[::-1]


def marginals(found: list[Segment], score: list[float]) -> list[float]:
    """Probability of each segment over all sets of non-overlapping segments, by forward and backward sums."""
    n = len(found)
    prior = [sum(s[1] <= a for s in found[:i]) for i, (a, *_) in enumerate(found)]
    fwd = [0.0] * (n + 1)
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    for i in range(n):
        fwd[i + 1] = add(fwd[i], fwd[prior[i]] + score[i])
    bwd = [-math.inf] * (n + 1)
    bwd[n] = 0.0
    for i in range(n, 0, -1):
        if bwd[i] == -math.inf:
            continue
        for to, gain in ((i - 1, 0.0), (prior[i - 1], score[i - 1])):
            bwd[to] = bwd[i] + gain if bwd[to] == -math.inf else add(bwd[to], bwd[i] + gain)
    return [math.exp(min(0.0, fwd[prior[i]] + score[i] + bwd[i + 1] - fwd[n])) if bwd[i + 1] > -math.inf else 0.0 for i in range(n)]


# ---------------------------------------------------------------------------------- training texts
#: Own vocabulary of the training texts: roads, places, everyday title words, forms of address.
EN_ROADS = "Maple Cedar Harbour Victoria Albert High Park Queens Chestnut Orchard Windmill Abbey Kingfisher Lower North".split()
DE_ROADS = "Linden Garten Schul Berg Kirch Bahnhof Rosen Wald Goethe Brunnen".split()
FR_ROADS = ["de la République", "du Parc", "des Écoles", "Pasteur", "Voltaire", "de l'Église", "des Tilleuls", "Jean Jaurès"]
ES_ROADS = ["Mayor", "de la Constitución", "del Carmen", "de los Reyes", "San Juan", "del Prado"]
PLACES = ["New York", "San Francisco", "Los Angeles", "Hong Kong", "Buenos Aires", "Cape Town", "Rio Grande", "Santa Cruz", "Saint Louis", "South Korea"]
TITLE_WORDS = "Annual Quarterly Monthly Final Draft Internal External Public Private Central Regional Global Digital Technical Legal Medical General Open Closed Red Blue Green Silver Northern Southern".split()
TITLE_NOUNS = "Report Review Meeting Office Department Council Project Programme Archive Library Office Service Group Team Board Desk Market Bridge Garden Hotel Station Release History Summary Falcon Otter".split()
LEGAL = ["Ltd.", "GmbH", "Inc.", "& Co.", "S.A.", "LLC", "AG", "Holdings", "Corp."]
DAYS = "Monday Tuesday Wednesday Thursday Friday Montag Dienstag Lundi Mardi Lunes Martes".split()
TITLES_BEFORE = ["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Herr ", "Frau ", "M. ", "Mme ", "Sr. ", "Sra. ", "Señor ", "Prof. "]
LABELLED = {
    "name": ["Name: ", "Contact: ", "Customer: ", "Nom : ", "Nombre: ", "Patient: ", "Dear ", "Regards, ", "Sincerely, ", "From ", "cc ", "by ", "with ", "für ", "von ", "para ", "pour ", "per ", "an ", "and ", "y ", "und ", "et "],
    "phone": ["Phone: ", "Tel.: ", "Tel. ", "Mobile: ", "Fax: ", "call ", "Telefon ", "Tél. ", "Teléfono: ", "at ", "unter ", "al ", "au ", "or ", "on ", "dial "],
    "email": ["Email: ", "E-mail: ", "Mail: ", "Correo: ", "Courriel : ", "to ", "an ", "à ", "a ", "write to ", "cc: ", "from ", "at "],
    "street_address": ["Address: ", "Adresse : ", "Anschrift: ", "Dirección: ", "Indirizzo: ", "lives at ", "wohnhaft ", "domicilié ", "to ", "at ", "in ", "en ", "au ", "an ", "nach ", "from "],
}
LATIN_PARTS = "ba be bo da de do fa fi ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo za ze zo".split()


def composed(rnd: random.Random, lexicon: Lexicon) -> tuple[str, list[tuple[int, int, str]]]:
    """A training text with its spans: personal data between labels, common words and invented words; about half of the parts are distractors."""
    given, family = sorted(lexicon.given), sorted(lexicon.family)
    pick, num = rnd.choice, rnd.randrange
    d = lambda n: "".join(str(num(10)) for _ in range(n))

    def word() -> str:
        return "".join(pick(LATIN_PARTS) for _ in range(num(2, 4)))

    def words(n: int) -> str:
        return " ".join(word() for _ in range(n))

    def name() -> str:
        g, f = pick(given), pick(family)
        if rnd.random() < 0.1:
            f += "-" + pick(family)
        if rnd.random() < 0.08:
            g += "-" + pick(given)
        if rnd.random() < 0.06:
            f = pick(["van ", "de ", "von ", "van der ", "da ", "O'"]) + f
        style = rnd.random()
        if style < 0.26 and " " in f:
            f = f.split(" ")[-1]  # a small word before a family name that stands first belongs to the sentence
        if style < 0.2:
            return f"{f}, {g}"
        if style < 0.26:
            return f"{f}, {g} {pick('ABDEFGHJKLMNPRST')}."
        if style < 0.4:
            g += f" {pick('ABDEFGHJKLMNPRST')}."
        full = f"{g} {f}"
        return full.upper() if rnd.random() < 0.15 else full

    def email() -> str:
        local = pick([pick(given).lower(), word()]) + pick(["", ".", "_", "-"]) + pick([pick(family).lower(), word()]) + pick(["", "", d(2), "+" + word()])
        host = pick(["mail", "post", word(), word() + "-" + word(), word() + "." + word()])
        tld = pick(["example", "com", "test", "org", "net", "de", "fr", "es", "co.uk", "invalid"])
        at, dot = pick([("@", ".")] * 6 + [(" @ ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" (at) ", "."), (" AT ", " (dot) "), (" at ", " dot "), ("(at)", "(dot)"), (" {at} ", " {dot} ")])
        return local + at + (host + "." + tld).replace(".", dot)

    def phone() -> str:
        n = pick("23456789")
        return pick([
            f"+1-{n}{d(2)}-555-{d(4)}", f"({n}{d(2)}) 555-{d(4)}", f"1 ({n}{d(2)}) 555 {d(4)}", f"{n}{d(2)}.555.{d(4)}", f"{n}{d(2)}-555-{d(4)}", f"+1{n}{d(9)}", f"+1 {n}{d(2)} 555 {d(4)}", f"+1 ({n}{d(2)}) {d(3)}-{d(4)}", f"{n}{d(2)} {d(3)} {d(4)}",
            f"+44 7700 {d(6)}", f"07700 {d(6)}", f"020 7946 {d(4)}", f"0044 20 7946 {d(4)}", f"+44 (0)7700 {d(3)} {d(3)}", f"+33 {pick('123456')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{pick('123456')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{pick('1234')}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+33639 98 {d(4)}", f"06 39 98 {d(2)} {d(2)}",
            f"030/{d(5)}-{d(3)}", f"+49 30 {d(5)}-{d(3)}", f"+49 (0)30 {d(8)}", f"0049 30 {d(5)} {d(3)}", f"030 {d(5)} {d(3)}", f"0{d(3)} {d(6)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+351 {d(3)} {d(3)} {d(3)}", f"+7 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"+81 {d(2)}-{d(4)}-{d(4)}", f"+55 {d(2)} 9{d(4)}-{d(4)}", f"+91 {pick('6789')}{d(4)} {d(5)}",
        ])

    def number(only: str = "") -> tuple[str, str]:
        """A valid identity number, as (scheme, text): a random filling of the scheme's shape that satisfies its check."""
        forms = {
            "ssn": ["999-99-9999", "999 99 9999", "999999999"], "sin": ["099 999 999", "999 999 999", "999-999-999", "999999999"], "bsn": ["999999999", "9999.99.999"], "nhs": ["999 999 9999", "9999999999", "999-999-9999"], "nir": ["1 99 09 99 999 999 99", "299099999999999"], "pesel": ["99999999999"],
            "dni": ["99999999L", "99999999-L", "99999999 L"], "cpf": ["999.999.999-99", "99999999999"], "steuer": ["99999999999", "99 999 999 999"], "aadhaar": ["9999 9999 9999"], "nrn": ["99.09.09-999.99"], "codice": ["LLLLLL99L09L999L"], "nino": ["LL 99 99 99 A", "LL999999B"],
            "nric": ["S9999999L", "T9999999L"], "rrn": ["990909-1999999"], "curp": ["LLLL990909HLLLLL99"], "personnummer": ["990909-9999"], "cpr": ["090999-9999"], "resident": ["999999199909099999"], "hkid": ["L999999(9)"], "my number": ["9999 9999 9999", "999999999999"], "teudat": ["999999999"], "za": ["9909099999099"],
            "cuil": ["20-99999999-9"], "rut": ["19.999.999-9"], "medicare": ["2999 99999 9"], "tfn": ["999 999 999"], "emirates": ["784-1999-9999999-9"], "ramq": ["LLLL 9909 0999"],
        }
        while True:
            kind, shape, check, _ = pick(SCHEME_SHAPES)
            if only and kind != only:
                continue
            for _ in range(60):
                s = "".join(str(num(10)) if c == "9" else pick("ABCDEFGHIJKLMNPQRSTVWXYZ") if c == "L" else c for c in pick(forms[kind]))
                if shape.fullmatch(s) and check(s):
                    return kind, s

    def address() -> str:
        n = num(1, 250)
        return pick([
            f"{pick(['', '', f'Flat {num(1, 40)}, ', f'Apt {num(1, 40)}, '])}{n}{pick(['', '', '', 'A', 'B'])} {pick(['', 'Old ', 'Upper ']) if rnd.random() < 0.2 else ''}{pick([*EN_ROADS, word().title()])} {pick(ROADS.split('|'))}",
            f"{pick([*DE_ROADS, word().title()])}{pick(['weg', 'straße', 'gasse', 'allee', 'stieg', 'platz', 'str.'])} {n}{pick(['', '', 'a', ' b', ' c'])}", f"{n}{pick(['', ' bis', ''])}{pick([',', ''])} {pick(['rue', 'avenue', 'impasse', 'allée', 'boulevard', 'place'])} {pick([*FR_ROADS, 'des ' + word().title(), 'du ' + word().title()])}",
            f"{pick(['Calle', 'Avenida', 'Plaza', 'Paseo', 'Rua', 'Via'])} {pick([*ES_ROADS, 'del ' + word().title(), 'de ' + word().title()])}{pick([' ', ', ', ', n.º '])}{n}{pick(['', '', '', 'A'])}", f"{word().title()}{pick(['straat', 'laan', 'plein', 'gracht'])} {n}", f"ul. {word().title()} {n}{pick(['', f'/{num(1, 90)}'])}",
        ])

    parts: list[tuple[str, str]] = []
    say = lambda s, kind="": parts.append((s, kind))
    made = {"name": name, "phone": phone, "email": email, "street_address": address}

    def lead(kind: str) -> str:
        roll = rnd.random()
        return pick(LABELLED[kind]) if roll < 0.4 else words(num(1, 3)) + " " if roll < 0.8 else word().title() + " " + words(1) + " " if kind != "name" else words(2) + ": " if roll < 0.9 else "The " + words(2) + " "

    def stop() -> str:
        return pick([". ", ". ", "\n", "; ", " " + words(2) + ". ", ", " + words(2) + ". ", " " + pick(["on", "by", "before", "and", "or"]) + " " + words(1) + ". "])

    def named(kind: str) -> str:
        cue = {"ssn": ["SSN", "social security no."], "nhs": ["NHS No.", "NHS", "NHS number"], "codice": ["codice fiscale", "CF"], "steuer": ["Steuer-ID", "IdNr"], "aadhaar": ["Aadhaar"], "nir": ["NIR", "numéro de sécurité sociale"], "nino": ["NINO", "National Insurance no."], "resident": ["身份证号"], "personnummer": ["personnummer"], "my number": ["マイナンバー", "My Number"], "teudat": ["Teudat Zehut"], "za": ["SA ID"], "medicare": ["Medicare"], "emirates": ["Emirates ID"], "rrn": ["RRN", "주민등록번호"]}.get(kind, [kind.upper()])
        return pick(cue) + pick([" ", ": ", " ", " ("])

    for _ in range(num(2, 6)):
        turn = num(24)
        if turn < 4:
            kind = list(made)[turn]
            say(lead(kind)), say(made[kind](), kind), say(stop())
        elif turn == 4:
            say(lead("name")), say(name(), "name"), say(pick([" on ", " at ", " unter ", " au ", " al ", ", ", " (", ": ", " " + words(1) + " "])), say(phone(), "phone"), say(stop())
        elif turn == 5:
            sep = pick(["\t", " | ", ";", "; ", ", "])
            for kind in rnd.sample(list(made), num(2, 5)):
                say(pick([d(4) + sep, word() + sep, "", sep])), say(f"{pick(given)} {pick(family)}" if sep == ", " and kind == "name" else made[kind](), kind), say(sep)
            say("\n")
        elif turn in (6, 7):
            kind, s = number()
            say(pick([words(num(1, 3)) + " ", "", "ID: ", "Document "]) + named(kind)), say(s, "id_number"), say(pick([". ", ") " + word() + ". ", "; ", " " + words(2) + ". ", "\n"]))
        elif turn == 8:
            s = number("ssn")[1] if rnd.random() < 0.8 else number(pick(sorted(NAMED)))[1]
            if not s.isdigit():
                say(pick([words(num(1, 3)) + " ", "ID ", "(", "number "])), say(s, "id_number"), say(pick([". ", ") ", " " + words(2) + ". "]))
        elif turn == 9:
            say(pick([lead("street_address"), lead("name")])), say(address(), "street_address"), say(pick([", ", " (", ", " + words(3) + " ", ", " + word() + " "])), say(name(), "name"), say(stop())
        elif turn == 10:
            say(lead("name")), say(name(), "name"), say(pick([", ", " (", ": "])), say(address(), "street_address"), say(stop())
        elif turn == 11:
            say(name(), "name"), say(pick([" " + words(2) + " ", " " + pick(["met", "wrote", "called", "und", "and", "et", "y"]) + " "])), say(pick([words(2) + ". ", "us. ", "the " + word() + ". "]))
        elif turn == 12:
            say(pick(["The " + words(2) + " ", words(2) + " "])), say(name(), "name"), say(pick([" and ", ", ", " or ", " und "])), say(name(), "name"), say(stop())
        elif turn == 13:
            say(pick(LABELLED["email"])), say(email(), "email"), say(pick([" or ", ", ", "; ", " / "])), say(phone(), "phone"), say(stop())
        elif turn == 14:  # numbers of other things
            say(pick([
                f"{pick(['Order', 'Invoice', 'Ticket', 'Part', 'Serial', 'Article', 'Range', 'Row', 'Batch', 'Lot', word().title()])} {pick([d(9), d(10), d(11), d(12), d(3) + '-' + d(3) + '-' + d(4), '9' + d(2) + '-' + d(2) + '-' + d(4), '000-' + d(2) + '-' + d(4), d(4) + '-' + d(2) + '-' + d(3), d(3) + ' ' + d(3) + ' ' + d(3), d(6) + '-' + d(4)])} {words(2)}. ",
                f"{words(2).capitalize()} {num(1, 28)}.{num(1, 12)}.{num(1990, 2030)}, {num(1990, 2030)}-{num(1, 12):02d}-{num(1, 28):02d} {num(24):02d}:{num(60):02d}. ", f"{words(1)} v{num(9)}.{num(30)}.{num(99)}.{d(4)} {words(1)} {num(1, 224)}.{num(255)}.{num(255)}.{num(255)}. ", f"{words(2)} {d(2)},{d(3)} {words(1)} {num(100)}.{d(1)} %. ",
            ]))
        elif turn == 15:  # valid numbers that nothing names
            kind, s = number()
            plain = s.isdigit() or kind in ("sin", "nhs", "personnummer", "cpr", "medicare", "tfn", "my number", "rut", "ramq")
            if plain:
                say(f"{pick(['Account', 'Order', 'Ledger', 'Code', word(), word()])} {s} {words(2)}. ")
        elif turn == 16:  # single names
            say(pick([f"{pick(['Room', 'Building', 'Studio', 'Hall', 'Project', 'Storm'])} {pick(given)} {words(2)}. ", f"{pick(TITLES_BEFORE)}{pick(family)} {words(2)}. ", f"{pick(family)} {pick(LEGAL)} {words(2)}. ", f"On {pick(DAYS)}, {pick(given)} {words(1)}. ", f"In {word().title()}, {pick(given)} {words(1)}. ", f"{pick(DAYS)} {pick(given)} {words(2)}. ", f"The {pick(given)} {pick(['Room', 'Building', 'Foundation', 'Prize'])} {words(1)}. ", f"{pick(given)}, {words(3)}. "]))
        elif turn == 17:  # titles, places and firms
            say(pick([f"The {pick(TITLE_WORDS)} {pick(TITLE_NOUNS)} {words(2)}. ", f"{pick(TITLE_WORDS)} {pick(TITLE_NOUNS)} {words(2)}. ", f"in {pick(PLACES)} {words(2)}. ", f"{word().title()} {word().title()} {pick(LEGAL)} {words(1)}. ", f"{pick(DAYS)} {pick(TITLE_WORDS)} {pick(TITLE_NOUNS)}. ", f"{pick(TITLE_WORDS)}, {pick(TITLE_NOUNS)} {words(1)}. ", f"Dear {pick(TITLE_WORDS)} {pick(TITLE_NOUNS)}, {words(2)}. ", f"{pick(['On', 'Since', 'Until', 'From', 'By', 'Last', 'Next'])} {pick(DAYS)} {pick(['the ', ''])}{words(2)}. ", f"{pick(['In', 'At', 'From', 'To', 'For'])} {word().title()} {words(2)}. ", f"{pick(['ABC', 'TKT', 'REQ', 'INC', 'CHG', 'FIN'])}-{d(6)} {words(2)}. ", f"{pick(TITLE_WORDS)} {pick(['ABC', 'TKT', 'REQ'])}-{d(5)} {words(2)}. ", f"{pick(LABELLED['name'])}{pick(TITLE_WORDS)} {pick(TITLE_NOUNS)}, {words(2)}. ", f"{pick(LABELLED['name'])}the {pick(TITLE_WORDS)} {pick(TITLE_NOUNS)}. "]))
        elif turn == 18:  # roads without a house number, numbers without a road
            say(pick([f"the {pick([*EN_ROADS, word().title()])} {pick(ROADS.split('|'))} {words(2)}. ", f"{pick(['Unit', 'Shelf', 'Rack', 'Bay', 'Gate'])} {num(60)}, {pick(['Lane', 'Row', 'Aisle', 'Court'])} {num(60)} {words(2)}. ", f"{pick(DE_ROADS)}{pick(['weg', 'straße', 'platz'])} {words(2)}. ", f"{num(2, 90)} {pick(['Court', 'Square', 'Close', 'Row'])} {words(1)}. "]))
        elif turn == 19:  # signs of addresses without one
            say(pick([f"@{word()}-{word()} {words(2)}. ", f"{word()}@ {words(2)}. ", f"www.{word()}.{pick(['com', 'example'])} at {words(1)}. ", f"https://{word()}.example/{word()}?{word()}={d(3)} {words(1)}. ", f"{words(1)} at {word()}.{pick(['pdf', 'csv', 'com'])} {words(1)}. ", f"@{word()} at {words(1)} dot {words(1)}. ", f"{word()}.{word()}_{d(4)}.{pick(['pdf', 'csv', 'json'])} {words(2)}. "]))
        elif turn == 20:  # sentences in capitals
            say(pick([f"{pick(TITLE_WORDS).upper()} {words(2).upper()} {pick(TITLE_NOUNS).upper()} {words(2).upper()}. ", f"{words(2).upper()} {pick(['ABC', 'TKT', 'REQ'])}-{d(6)} {words(2).upper()}. ", f"É{word().upper()} Ã{words(2).upper()} {d(4)} {words(3).upper()}. ", f"{words(4).upper()}: {words(2).upper()}. ", f"{words(2).upper()} {d(6)} {words(2).upper()}. "]))
        elif turn == 21:  # garbled letters look like capitals
            raw = pick(["Привет, мир, это", "Καλημέρα κόσμε, αυτό", "Übergröße für Äpfel", "été, où, garçon", "你好，世界"]).encode().decode(pick(["cp1252", "latin-1", "mac_roman", "cp437"]), "replace")
            say(f"{raw} {d(4)} {raw}. ")
        elif turn == 22:
            script = pick(list(NATIVE))
            g, f = (pick(x) for x in NATIVE[script])
            full = {"han": f + g, "hangul": f + g}.get(script, f"{g} {f}" if rnd.random() < 0.8 or script != "cyrillic" else f"{f} {g} {pick(['Иванович', 'Петровна', 'Сергеевич'])}")
            label = {"cyrillic": ["Имя: ", "ФИО: ", "г-н ", "от ", "для "], "greek": ["Όνομα: ", "κ. ", "από "], "han": ["姓名：", "氏名：", "担当者："], "hangul": ["이름: ", "담당자: "], "arabic": ["الاسم: ", "السيد ", "الدكتورة "], "hebrew": ["שם: ", "מר "], "devanagari": ["नाम: ", "श्री "], "thai": ["ชื่อ: ", "คุณ"]}[script]
            if script in ("han", "hangul") and rnd.random() < 0.5:
                say(pick(["", "、", "。"])), say(full, "name"), say(pick(["さん", "先生", "様"] if script == "han" else ["씨", "님"])), say("。" if script == "han" else ". ")
            else:
                say(pick(label)), say(full, "name"), say(pick([". ", "\n", ", ", " (" + d(2) + ") "]))
        else:
            n = num(1, 200)
            which = pick([f"ул. {pick(['Ленина', 'Садовая', 'Мира'])}, д. {n}", f"улица {pick(['Пушкина', 'Гагарина'])}, {n}", f"οδός {pick(['Ερμού', 'Αθηνάς'])} {n}", f"{pick(['建国', '中山', '人民'])}路{n}号", f"{pick(['丸の内', '銀座'])}{num(1, 9)}-{num(1, 30)}-{num(1, 30)}", f"{pick(['세종', '강남'])}대로 {n}", f"شارع {pick(['الملك فهد', 'النصر'])} {n}", f"{n} {pick(['गांधी', 'नेहरू'])} मार्ग", f"{n} ถนน{pick(['สุขุมวิท', 'พระราม'])}", f"רחוב {pick(['הרצל', 'דיזנגוף'])} {n}"])
            if rnd.random() < 0.75:
                say(pick(["Адрес: ", "住所：", "주소: ", "address ", "العنوان: ", ""])), say(which, "street_address"), say(pick([". ", "\n", "。"]))
            else:
                say(pick(["Большой Театр открыт. ", "Красная Площадь закрыта. ", "Новая Версия вышла. ", "Καλή Χρονιά σε όλους. ", "Νέα Έκδοση. ", "Лишь Иван пришёл. ", "الملف الجديد. ", "नई सूची है। "]))
    text, spans = "", []
    for s, kind in parts:
        if kind:
            spans.append((len(text), len(text) + len(s), kind))
        text += s
    return text, spans


def train(lexicon: Lexicon, texts: int = 3000, rounds: int = 8, rate: float = 0.3, decay: float = 2e-4, seed: int = 11) -> dict[str, float]:
    """Weights by stochastic ascent of the conditional likelihood of the training texts."""
    rnd = random.Random(seed)
    lexicon = Lexicon(lexicon.given, lexicon.family, lexicon.common | {w.lower() for w in TITLE_WORDS + TITLE_NOUNS})
    data = []
    for _ in range(texts):
        text, spans = composed(rnd, lexicon)
        # one name in eight is unknown to each lexicon, in some texts most are, so that shape and cues carry weight too
        gone = (0.7, 0.7) if rnd.random() < 0.25 else (0.12, 0.2)
        seen = Lexicon({g for g in lexicon.given if rnd.random() > gone[0]}, {f for f in lexicon.family if rnd.random() > gone[1]}, lexicon.common)
        found = segments(folded(text)[0], seen)
        gold = {(a, b, k) for a, b, k in spans}
        data.append((found, [float((a, b, k) in gold) for a, b, k, _ in found]))
    w: dict[str, float] = defaultdict(float)
    for turn in range(rounds):
        step = rate / (1 + turn)
        rnd.shuffle(data)
        for found, gold in data:
            probs = marginals(found, [sum(w[f] for f in s[3]) for s in found])
            # a true span may be proposed by several shapes; together they count once
            shared: dict[tuple[int, int, str], float] = defaultdict(float)
            for s, p in zip(found, probs):
                shared[s[:3]] += p + 1e-9
            gold = [y * (p + 1e-9) / shared[s[:3]] for s, p, y in zip(found, probs, gold)]
            for s, p, y in zip(found, probs, gold):
                for f in s[3]:
                    w[f] += step * (y - p) - step * decay * w[f]
    return {f: round(x, 4) for f, x in w.items() if abs(x) > 1e-3}


BEFORE = re.compile(rf"({UP}[^\W\d_]+)(?: {UP}\.)? $")
#: A family name follows a known given name at least once in so many times that it is written.
RARELY = 50


def evidence_of(texts: Iterable[str]) -> Counter:
    """What texts tell about names, counted: (what, given name or word, family name). All texts are searched as one."""
    whole = "\n".join(folded(t)[0] for t in texts)
    counts: Counter = Counter({("lower", word, ""): n for word, n in Counter(LOWER.findall(whole)).items()})
    for word, n in Counter(TOKEN.findall(whole)).items():
        for part in word.title().split("-"):
            counts["written", part, ""] += n
    for word, n in Counter(COUNTED.findall(whole)).items():
        counts["counted", word, ""] += n
    for (given, _, family), n in Counter(FULL.findall(whole)).items():
        counts["pair", given.title(), family.title()] += n
    for m in LISTED.finditer(whole):
        before = BEFORE.search(whole, max(0, m.start() - 30), m.start())
        if not before or before.group(1).title() not in GIVEN:
            counts["listed", m.group(2).title(), m.group(1).title()] += 1
    return counts


def evidence(texts: DataFrame) -> DataFrame:
    """(what, given, family, n) over all distinct texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = evidence_of(frame["text"])
            yield pd.DataFrame([(*e, n) for e, n in counts.items()], columns=["what", "given", "family", "n"])

    return texts.distinct().mapInPandas(run, "what string, given string, family string, n bigint").groupBy("what", "given", "family").agg(F.sum("n").alias("n"))


def grown_lexicon(texts: DataFrame) -> Lexicon:
    """Lexicons grown from all texts: family names follow given names and the other way round.

    Pairs and counts stay in Spark; the driver sees the names and those common words that stand in pairs.
    """
    counts = cut(evidence(texts))
    pairs = counts.where("what in ('pair', 'listed')")
    words = pairs.select(F.explode(F.split(F.lower(F.concat_ws(" ", "given", "family")), "[ -]")).alias("word")).distinct()
    common = counts.where("what = 'lower' and n >= 2").select(F.col("given").alias("word")).join(words, "word", "left_semi")
    numbered = counts.where("what = 'counted'").select(F.col("given").alias("part"))
    written = counts.where("what = 'written'").select(F.col("given").alias("part"), F.col("n").alias("written"))
    common_words = {r.word for r in common.collect()}

    def partners(known: set[str], given_known: bool) -> DataFrame:
        """(part, what, partner, n): parts of the names whose partner is known as a whole."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = []
                for what, g, f, n in zip(frame["what"], frame["given"], frame["family"], frame["n"]):
                    gs, fs = g.split("-"), f.split(" ")[-1].split("-")
                    if all(x in known for x in (gs if given_known else fs)):
                        made += [(part, what, g if given_known else f, n) for part in (fs if given_known else gs)]
                yield pd.DataFrame(made, columns=["part", "what", "partner", "n"])

        return pairs.mapInPandas(run, "part string, what string, partner string, n bigint").where("length(part) > 2")

    given, family = set(GIVEN), set()
    for _ in range(3):
        followed = partners(given, True).groupBy("part").agg(F.countDistinct("partner").alias("partners"), F.sum("n").alias("n")).where("partners >= 2")
        # a word that begins sentences follows a given name now and then, in many texts more than twice
        followed = followed.join(written, "part").where(f"n * {RARELY} >= written")
        family = {r.part for r in followed.collect() if r.part.lower() not in common_words}
        # a given name stands before families as well as behind them
        sides = partners(family, False).groupBy("part").agg(*(F.countDistinct(F.when(F.col("what") == w, F.col("partner"))).alias(w) for w in ("pair", "listed")))
        both = sides.where("pair >= 2 and listed >= 2").join(numbered, "part", "left_anti")
        new = {r.part for r in both.collect() if r.part.lower() not in common_words} - given
        if not new:
            break
        given |= new
    if len(family) < 30:
        family |= set("Smith Johnson Williams Brown Jones Miller Davis Garcia Martinez Lopez Müller Schmidt Schneider Fischer Weber Meyer Dupont Moreau Laurent Rossi Russo Bianchi Silva Santos Ferreira Novak Ivanov Petrov Kim Tanaka Singh Patel Khan Hassan Larsen".split())
    return Lexicon(given, family, common_words)


def fit(texts: DataFrame, text: str = "text") -> dict:
    """Lexicon and weights; the lexicon from all texts."""
    lexicon = grown_lexicon(texts.select(F.col(text).alias("text")).where("text is not null"))
    return {"given": sorted(lexicon.given), "family": sorted(lexicon.family), "common": sorted(lexicon.common), "weights": train(lexicon)}


QUICK = re.compile(r"[@＠]|\d[\d\W]{5,}\d|\d{8}|[(\[{]\s?(?:at|a)\s?[)\]}]| (?:at|AT) |\d|[^\W\d_a-z]")


def find(text: str, lexicon: Lexicon, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of a text, in code points of the original."""
    plain, places = folded(text)
    out = []
    for a, b, kind, _ in decode(segments(plain, lexicon), weights):
        out.append((a, b, kind) if places is None else (places[a], places[b - 1] + 1, kind))
    return out


PLACEHOLDER = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID_NUMBER>", "street_address": "<STREET_ADDRESS>", "name": "<NAME>"}


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def redact(records: DataFrame, model: dict, record_id: str, text: str = "text") -> DataFrame:
    """(id, findings, redacted_text) of every record with a text, repeated rows once."""
    rows = records.select(F.col(record_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    rows = by_key(rows, "id", "text").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(set(model["given"]), set(model["family"]), set(model.get("common", ())))
        for frame in frames:
            found = [find(t, lexicon, model["weights"]) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "id": frame["id"],
                    "findings": [[{"kind": k, "span_start": a, "span_end": b, "text": t[a:b]} for a, b, k in spans] for t, spans in zip(frame["text"], found)],
                    "redacted_text": [redacted(t, spans) for t, spans in zip(frame["text"], found)],
                }
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, findings array<struct<kind:string,span_start:bigint,span_end:bigint,text:string>>, redacted_text string")
