"""Patterns, word lists and limits of the scan.

Fixed values: they must equal the original tool's for the same findings. (?U) makes \\d and \\s
cover Unicode, as they do there. \\w is written out as WORD: with (?U) it takes marks and no numbers like ², there the reverse.
"""

CATEGORY_LABELS = {
    "private_person": "人名",
    "private_address": "住所",
    "private_phone": "電話番号",
    "private_email": "メールアドレス",
    "private_date": "個人に関する日付(生年月日等)",
    "account_number": "口座番号・カード番号等",
    "private_url": "個人に紐づくURL",
    "secret": "秘密情報の疑い",
    "my_number": "マイナンバー",
    "location_gps": "位置情報(GPS)",
    "metadata_person": "ファイルの作成者情報",
}

PROSE_EXTENSIONS = (
    ".txt", ".md", ".markdown", ".rst", ".csv", ".tsv", ".log", ".rtf", ".html", ".htm",
    ".tex", ".org", ".adoc", ".eml", ".vcf", ".ics", ".srt", ".vtt", ".text",
)
PROSE_NAMES = (
    "license", "licence", "copying", "authors", "contributors", "notice", "maintainers",
    "credits", "changelog", "changes", "readme", "history", "thanks", "owners", "codeowners",
)
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tif", ".tiff")

PREFECTURES = (
    "北海道|青森県|岩手県|宮城県|秋田県|山形県|福島県|茨城県|栃木県|群馬県|埼玉県|千葉県|東京都|神奈川県|"
    "新潟県|富山県|石川県|福井県|山梨県|長野県|岐阜県|静岡県|愛知県|三重県|滋賀県|京都府|大阪府|兵庫県|"
    "奈良県|和歌山県|鳥取県|島根県|岡山県|広島県|山口県|徳島県|香川県|愛媛県|高知県|福岡県|佐賀県|長崎県|"
    "熊本県|大分県|宮崎県|鹿児島県|沖縄県"
)
BLOCK_NUMBER = "[0-9０-９一二三四五六七八九十〇]"

#: Characters of words, inside a class. Java looks behind by whole characters above U+FFFF only if the pattern has one, so
#: here and in each other class that is looked behind for one stands, which is in the class anyway.
WORD = r"\p{L}\p{N}_𐐀"
_DIGIT = r"\d𝟗"
EMAIL = rf"(?U)(?<![{WORD}.%+-])[A-Za-z0-9._%+\-]{{1,64}}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,24}}(?![{WORD}-])"
EMAIL_IGNORED = rf"(?Ui)@(?:[{WORD}\-]+\.)*(?:example\.(?:com|org|net)|example|test|invalid|localhost)$"
JP_PHONE = rf"(?U)(?<![{_DIGIT}\-])(?:0\d{{1,4}}-\d{{1,4}}-\d{{3,4}}|0[5789]0\d{{8}}|\(0\d{{1,4}}\)\s?\d{{1,4}}-\d{{4}})(?![\d\-])"
INTL_PHONE = rf"(?U)(?<![{WORD}+])\+\d{{1,3}}[\s\-]?\(?\d{{1,4}}\)?(?:[\s\-]?\d{{2,4}}){{2,4}}(?![\d])"
POSTAL = r"(?U)〒\s?[0-9０-９]{3}[-－ー]?[0-9０-９]{4}"
ADDRESS = (
    rf"(?U)(?:{PREFECTURES})[^\s、。,，「」()（）]{{1,12}}?[市区町村郡][^\s、。,，「」()（）]{{0,24}}?"
    rf"(?:{BLOCK_NUMBER}+丁目|{BLOCK_NUMBER}+番地?|{BLOCK_NUMBER}+[-－ー]{BLOCK_NUMBER}+)(?:[-－ー]?{BLOCK_NUMBER}+){{0,2}}(?:号)?"
)
MY_NUMBER = rf"(?U)(?<![{_DIGIT}])\d{{4}}[\s\-]?\d{{4}}[\s\-]?\d{{4}}(?!\d)"
MY_NUMBER_CONTEXT = r"(?Ui)マイナンバー|個人番号|my\s?number"
CARD = rf"(?U)(?<![{_DIGIT}])(?:\d{{4}}[ \-]){{3}}\d{{1,7}}(?!\d)|(?<![{_DIGIT}])\d{{14,16}}(?!\d)"
CARD_CONTEXT = "(?i)card|カード|クレジット|credit|visa|master|amex|jcb"
CARD_PREFIX = "^(4|5[1-5]|2[2-7]|3[47]|35|36|38|6)"
BANK = r"(?U)(?:口座番号|普通預金|当座預金|普通|当座)\s*[:：]?\s*(?:No\.?\s*)?([0-9０-９]{7})(?![0-9０-９])"
MODEL_WORTHY = (
    rf"(?U)[぀-ヿ㐀-鿿ｦ-ﾟ]|@|\d{{2,4}}[-\s]\d{{2,4}}[-\s]\d{{3,4}}|(?<![{WORD}])[A-Z][a-z]+ [A-Z][a-z]+(?![{WORD}])|"
    "(?i:name|address|addr|phone|tel|mobile|e-?mail|birth|dob|author|copyright|contact|owner|street|city|zip|postal|customer)"
)
#: The same in parts that are cheap to look for: words in small letters (each has one of MODEL_WORTHY's, in whatever case), a
#: pattern for what isn't a word, and two capitalised words, which are looked for without and then with their surroundings.
MODEL_WORDS = ("name", "addr", "phone", "tel", "mobile", "email", "e-mail", "birth", "dob", "author", "copyright", "contact", "owner", "street", "city", "zip", "postal", "customer")
MODEL_MARKS = r"(?U)[぀-ヿ㐀-鿿ｦ-ﾟ]|\d{2,4}[-\s]\d{2,4}[-\s]\d{3,4}"
MODEL_NAMES = ("[A-Z][a-z]+ [A-Z][a-z]", rf"(?U)(?<![{WORD}])[A-Z][a-z]+ [A-Z][a-z]+(?![{WORD}])")
#: Letters beyond ASCII that a pattern without case takes as s or i.
ODD_CASE = ("ſ", "ı", "İ")
HUMAN_FILENAME = r"[぀-ヿ㐀-鿿]| |[A-Z][a-z]+[_\-.][A-Z][a-z]+"
EDGE_PUNCTUATION = ",;:()<>[]{}\"'`「」『』、。，．・"

#: Kind by the first bytes, as hexadecimal prefixes.
MAGIC = (
    ("pdf", "25504446"), ("image", "89504E470D0A1A0A"), ("image", "FFD8FF"), ("image", "474946383761"), ("image", "474946383961"),
    ("image", "424D"), ("image", "49492A00"), ("image", "4D4D002A"), ("zip", "504B0304"), ("zip", "504B0506"), ("gzip", "1F8B"),
    ("bz2", "425A68"), ("xz", "FD377A585A00"), ("x:7z", "377ABCAF271C"), ("x:rar", "526172211A07"), ("x:zstd", "28B52FFD"),
)
#: Office kinds by the members that mark them.
OFFICE_MARKS = (("docx", ("word/document.xml",)), ("xlsx", ("xl/workbook.xml",)), ("pptx", ("ppt/presentation.xml",)), ("odf", ("content.xml", "mimetype")))
OFFICE_AUTHOR = "<{tag}[^>]*>([^<]+)</{tag}>"
XML_LINE_END = r"</(?:w:p|a:p|text:p|text:h)>|<(?:w:br|w:tab|a:br|text:line-break)[^>]*/?>|</si>|</row>"
XML_CELL_END = "</c>|</w:tc>"
XML_TAG = "<[^>]+>"
CJK = r"[\u3040-\u30ff\u3400-\u9fff]"

OFFICE_PARTS = {
    "docx": r"^word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$",
    "xlsx": r"^xl/(sharedStrings|worksheets/sheet\d+|comments\d*)\.xml$",
    "pptx": r"^ppt/(slides/slide\d+|notesSlides/notesSlide\d+|comments/.*)\.xml$",
    "odf": r"^(content|meta)\.xml$",
}
OFFICE_META = r"^docProps/(core|app)\.xml$"
OFFICE_MEDIA = ("word/media/", "ppt/media/", "xl/media/", "Pictures/")
OFFICE_AUTHOR_TAGS = ("dc:creator", "cp:lastModifiedBy", "meta:initial-creator", "Company", "Manager")
IMAGE_AUTHOR_TAGS = ("Artist", "Copyright", "CameraOwnerName", "XPAuthor", "author", "Author")
IMAGE_TEXT_TAGS = ("ImageDescription", "comment", "description", "title", "copyright", "source", "xml:com.adobe.xmp")

TOO_DEEP = "archive nesting too deep"
NO_ARCHIVE = "uninspectable archive"
NO_PDF_TEXT = "PDF without text layer (no OCR available)"
TOO_LARGE = "text too large for PII scan (>50MB)"
BINARY = "binary (not PII-scanned)"

MAX_SCANNED_CHARS = 20_000
MAX_MODEL_LINE_CHARS = 2_000
MAX_LOCATIONS = 20
MAX_SKIP_EXAMPLES = 10
MAX_METADATA_CHARS = 5_000
MAX_TEXT_BYTES = 50 * 1024 * 1024
MAX_ARCHIVE_DEPTH = 4
DOWNLOAD_LIMIT_BYTES = 30_000_000
MAX_FILE_BYTES = 300 * 1024**3
LIFETIMES = (3, 5, 7, 14, 30, 60, 100)
TOKEN_BUDGET = 40_000
MODEL_WINDOW, MODEL_CONTEXT = 1536, 128
MIN_SPAN_SCORE = 0.6
OCR_MIN_SIDE, OCR_MIN_AREA, MAX_OCR = 120, 60_000, 40
MAX_VISUAL, MIN_OCR_CHARS = 20, 4
# End of fixed values.

#: Reasons of our own.
UNPACKS_TOO_FAR = "archive unpacks to more than the limit"
