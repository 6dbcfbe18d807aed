"""Word lists, patterns and constants that results depend on."""

# Stop words of the lexical index.
INDEX_STOPWORDS = (
    "a an anh ay bi boi cac can cho co con cua duoc da de den di do doi duoi gi hay hoac khi la lai lam mot nay neu "
    "nhu nhung o phai qua quy rieng sau se thi the theo trong tu va ve viec voi"
).split()

# Stop words of the evidence tokenizer.
EVIDENCE_STOPWORDS = (
    "a an anh ay bi boi cac can cho co con cua duoc da de den di do doi duoi gi hay hoac khi la lai lam mot nay neu "
    "nhu nhung o phai qua quy rieng sau se thi theo thuoc toi trong tu va ve vi voi"
).split()

# Lines that are dropped when a text is cleaned (any case).
HEADER_LINES = (
    r"^\s*CỘNG\s+HÒA\s+XÃ\s+HỘI\s+CHỦ\s+NGHĨA\s+VIỆT\s+NAM\s*$",
    r"^\s*Độc\s+lập\s*[-–]\s*Tự\s+do\s*[-–]\s*Hạnh\s+phúc\s*$",
    r"^\s*Số\s*:\s*[\w./-]+.*$",
    r"^\s*(Hà\s+Nội|TP\.?\s*Hồ\s+Chí\s+Minh|Thành\s+phố\s+Hồ\s+Chí\s+Minh),?\s+ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}.*$",
)
DIVIDER_LINE = r"^\s*[-=_.*•\s]{5,}\s*$"
FOOTER = r"\n\s*(Nơi\s+nhận\s*:|KT\.\s*[^:\n]{0,80}\n|TM\.\s*[^:\n]{0,80}\n)"
FOOTER_SHARE = 0.45

# Lower-case letters that a broken line goes on with, and letters around a hyphen.
LOWER_LETTERS = "a-zà-ỹ"
LETTERS = "A-Za-zÀ-ỹ"

# Section boundaries (any case, line by line), and what a heading of each level begins with.
BOUNDARIES = (
    r"Chương\s+[IVXLCDM\d]+[^\n]{0,180}",
    r"Mục\s+\d+[^\n]{0,180}",
    r"Điều\s+\d+[a-zA-Z]?\s*[.:]?[^\n]{0,220}",
    r"Khoản\s+\d+[^\n]{0,180}",
    r"Điểm\s+[a-zđ]\s*[).][^\n]{0,180}",
    r"Phụ\s*lục\s+[A-Z\dIVXLCDM]*[^\n]{0,180}",
)
LEVELS = ("chapter", "section", "article", "clause", "point", "appendix")
LEVEL_PREFIX = {"chapter": "chuong", "section": "muc", "article": "dieu", "clause": "khoan", "point": "diem", "appendix": "phu luc"}
#: Levels that a heading of the key's level ends.
LEVEL_RESETS = {
    "chapter": ("section", "article", "clause", "point"),
    "section": ("article", "clause", "point"),
    "article": ("clause", "point"),
    "clause": ("point",),
    "point": (),
    "appendix": ("chapter", "section", "article", "clause", "point"),
}

# Document types, first match wins; patterns on de-accented lower-case text.
DOC_TYPES = (
    ("luat", r"\b(luat|bo luat)\b"),
    ("nghi_dinh", r"\bnghi\s+dinh\b"),
    ("thong_tu", r"\bthong\s+tu\b"),
    ("quyet_dinh", r"\bquyet\s+dinh\b"),
    ("nghi_quyet", r"\bnghi\s+quyet\b"),
    ("qcvn", r"\bqcvn\b|quy\s+chuan"),
    ("tcvn", r"\btcvn\b|tieu\s+chuan"),
    ("cong_van", r"\bcong\s+van\b"),
)
#: What of them can match when only vowels lose their accents and patterns keep theirs.
DOC_TYPES_COMPAT = (("luat", r"\bbo luat\b"), ("qcvn", r"\bqcvn\b"), ("tcvn", r"\btcvn\b"))
YEAR = r"\b(19\d{2}|20\d{2})\b"
ISSUE_NUMBER = r"\b\d{1,4}/\d{4}/[A-ZĐA-Z0-9.-]+|\b\d{1,5}/[A-ZĐA-Z0-9.-]+|\b\d{1,5}\s*[-/]\s*\d{4}\b"
AMENDMENT_SIGNALS = ("sua doi", "bo sung", "thay the", "bai bo", "het hieu luc", "dinh chinh")
REPEAL_SIGNALS = ("bai bo", "het hieu luc", "ngung hieu luc")
METADATA_CHARS = 4000

# Document types a question names, by substring of its lower-case text.
QUESTION_TYPES = {
    "luat": ("luật", "bộ luật"),
    "nghi_dinh": ("nghị định",),
    "thong_tu": ("thông tư",),
    "quyet_dinh": ("quyết định",),
    "qcvn": ("qcvn", "quy chuẩn"),
    "tcvn": ("tcvn", "tiêu chuẩn"),
}
QUESTION_NUMBER = r"\b\d{1,5}(?:/\d{4})?(?:/[a-zA-ZĐđ0-9.-]+)?\b"

# Retrieval constants.
WINDOW_WORDS, OVERLAP_WORDS, LONG_SECTION_WORDS = 320, 60, 900
TOP_CHUNKS, TOP_DOCS, RERANK_DOCS, ANSWER_DOCS = 300, 100, 50, 5
RRF_K = 60
MISSING_RANK = 999
RECALL_DEPTHS = (1, 5, 20, 50, 90, 100)
