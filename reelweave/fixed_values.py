"""Patterns, word lists, lookup tables and formats.

Everything in this module is a constant that decides results; none of it is
logic.  Patterns are written in RE2 syntax and are handed to Spark through
``functions.regex.to_java``, which pins the ASCII meaning RE2 gives them.
"""

# --- fixed values: title prefixes -------------------------------------------
PREFIX_BRACKETED_SITE = r"(?i)^\s*\[[\w.-]+\]\s*[-:]?\s*"
PREFIX_DOMAIN = r"(?i)^\s*(?:www\.)?[a-zA-Z0-9-]+(?:\.[a-zA-Z]{2,})+\s*[-:]\s*"
PREFIX_SITE_NAME = (
    r"(?i)^\s*(?:TamilMV|TamilBlasters|1TamilMV|TamilRockers|Isaimini|TamilGun|TamilYogi)"
    r"\s*(?:\.\w+)?\s*[-:]\s*"
)
PREFIX_WWW = r"(?i)^www\.[a-z0-9-]+\.[a-z]{2,4}\s*-\s*"

# --- fixed values: years -----------------------------------------------------
YEAR_MIN, YEAR_MAX = 1900, 2030
YEAR_BRACKETED = r"(?i)[\(\[]((?:19|20)\d{2})\s*[-&,/a-z\s]*(?:(?:19|20)\d{2})?[\)\]]"
YEAR_BARE_RANGE = r"(?i)\b((?:19|20)\d{2})\s*(?:-|to|and|&)\s*(?:19|20)\d{2}\b"
YEAR_BARE = r"\b((?:19|20)\d{2})\b"
YEAR_LOOSE = r"\s*[\(\[]?\d{4}[\)\]]?"

# --- fixed values: where a title ends ---------------------------------------
BOUNDARIES = [
    r"\s+(?:2160p|1080p|720p|480p|360p|4K|UHD|HDR)\b",
    r"\s+(?:WEB[-_]?DL|WEB[-_]?Rip|Blu[-_]?Ray|BDRip|BRRip|HDTV|DVDRip|CAM|TS|TC)\b",
    r"\s+(?:AAC|AC3|DTS|DDP|DD5\.1|TrueHD|Atmos)\b",
    r"\s+(?:x264|x265|HEVC|AVC|H\.264|H\.265)\b",
    r"\s+(?:Tamil|Telugu|Hindi|Malayalam|Kannada|English|Dual|Multi)\b",
    r"\s+(?:Proper|Repack|Extended|Unrated|Remastered)\b",
    r"\s+\d+(?:\.\d+)?\s*(?:GB|MB|KB)\b",
]
FORUM_BOUNDARY = (
    r"(?i)\b(?:[Ss]\d{1,2}|EP\s*\(?\d+|Season\s*\d+|Episode\s*\d+|DAY\s*\d+|GRAND\s+FINALE|FINALE|TRUE"
    r"|2160p|1080p|720p|480p|360p|4k|uhd|bdrip|bluray|blu[-_]?ray|web[-_]?dl|web[-_]?rip|hdrip|dvdrip"
    r"|hdtv|sdtv|untouched)\b"
)
BOXSET_WORDS = (
    r"(?i)\b(?:Duology|Trilogy|Pentalogy|Quadrilogy|Hexalogy|Octology|Anthology|Collection|Boxset)\b"
)
ORPHAN_TAIL = (
    r"(?i)\b(?:TRUE|AND|DAY\s*\d+|GRAND\s+FINALE|FINALE|BDRIP|WEBDL|WEB-DL|HDRIP|DVDRIP"
    r"|1080P|720P|480P|4K|UHD)\b.*$"
)

# --- fixed values: punctuation and spaces -----------------------------------
BRACKETS = r"[()\[\]{}]"
SPACED_PUNCT = "\\s+[,<>\\/\\\\;:'\"|`~!?@$%^*\\_\\-=]\\s+"
SUFFIX_PUNCT = r"[':\?,]([sm]\s|\s|$)"
TRAILING_PUNCT = r"[\s\-_,:&]+$"
EDGE_CHARS = " .-_[]()/\\"
TRAILING_ARTICLES = ["The", "A", "An", "Le", "La", "Les"]
LEADING_ARTICLES = ["the", "a", "an", "le", "la", "les"]
URL_OR_MAIL = r"\b(https?://\S+|www\.\S+\.\w+|[\w.-]+@[\w.-]+)\b"
NOISY_BRACKET = r"\[.*?[^\w\s-].*?\]"
EPISODE_TOKEN = r"(?i)(S\d+)?[\s\-_]*\bEP[\s\-_]*[\(\[]?\s*(\d+)\s*[\)\]]?\b"

# --- fixed values: bracketed metadata ---------------------------------------
BRACKET_TOKENS = [
    "1080p", "720p", "2160p", "4k", "uhd", "bluray", "bdrip", "brrip",
    "web-dl", "webdl", "webrip", "hdrip", "dvdrip", "hdtv", "hevc", "x264", "x265",
    "aac", "ddp", "dd5", "ac3", "dts", "atmos", "esub", "msub", "dubbed", "dub",
    "audios", "kbps", "untouched", "multi", "original",
]
SIZE_TEXT = r"(?i)\b\d+(?:\.\d+)?\s*(?:GB|MB|KB)\b"
SIZE_GLUED = r"\b\d+(\.\d+)?[gmk]b\b"
CHANNEL_TEXT = r"\b(?:ddp)?\d\.\d(?:\.\d)?\b"

# --- fixed values: words that are metadata, not title -----------------------
METADATA_WORDS = [
    "proper", "repack", "extended", "unrated", "remastered",
    "x264", "x265", "hevc", "avc", "aac", "ac3", "dts",
    "720p", "1080p", "2160p", "480p", "4k", "uhd",
    "webdl", "webrip", "bluray", "hdtv", "dvdrip",
    "gb", "mb", "kb", "esub", "sub", "subs",
]
JUNK_WORDS = METADATA_WORDS + ["untouched", "true", "hq"]
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "of", "for", "with", "by", "at", "to", "in", "on",
]
JUNK_PARTS = ["ddp", "aac", "dts", "dolby", "atmos"]

# --- fixed values: season and episode patterns ------------------------------
SEASON = r"(?i)\b(?:s|season|series)[\s\-_]*(\d+)\b"
SEASON_FOLDER = r"(?i)\b(?:s|season|series)\s*0*(\d+)\b"
EPISODE_RANGE = r"(?i)(?:s\d+)?\s*(?:ep?|episode)[\s\-_]*[\(\[]?\s*(\d+)\s*(?:-|to)\s*(\d+)\s*[\)\]]?"
LOOSE_RANGE = r"(?i)\b(?:e|ep|episode)?\s*(\d+)\s*(?:-|to)\s*(?:e|ep|episode)?\s*(\d+)\b"
EPISODE_SINGLE = r"(?i)\b(?:e|ep|episode)[\s\-_]*(\d+)\b"
DAILY_DATE = r"\b(19|20)\d{2}\s*[\.-]?\s*(0[1-9]|1[0-2])\s*[\.-]?\s*(0[1-9]|[12]\d|3[01])\b"
BARE_EPISODE = r"\s+([0-9]{3,4})\s+"
LOOSE_RANGE_LIMIT = 1000

# --- fixed values: file path patterns ---------------------------------------
PATH_S_E_RANGE = r"(?i)\bs(\d{1,2})e(\d{1,3})-e(\d{1,3})\b"
PATH_S_DOT_E = r"(?i)\bs(\d{1,2})\.e(\d{1,3})(?:-e(\d{1,3}))?\b"
PATH_N_X_N = r"(?i)\b(\d{1,2})x(\d{1,3})(?:-(\d{1,3}))?\b"
PATH_RANGE = (
    r"(?i)\b(?:e|ep|episode)?[\s\-_]*[\(\[]?\s*(\d+)\s*(?:-|to)\s*(?:e|ep|episode)?\s*(\d+)\s*[\)\]]?\b"
)
PATH_SEASON = r"(?i)\bs(\d+)\b"
PATH_S_TO_S = r"(?i)\bs(\d{1,2})-s(\d{1,2})\b"
PATH_SEASON_TO = r"(?i)\bseason\s*(\d{1,2})\s*-\s*(\d{1,2})\b"
PATH_S_E = r"(?i)\bs(\d{1,2})e(\d{1,3})\b"
PATH_LOOSE_S_E = r"(?i)s(\d+)\s*e(\d+)"
PATH_LOOSE_S_EP = r"(?i)s(\d+)[\s\-_]*ep(?:isode)?[\s\-_]*(\d+)"
PATH_EP = r"(?i)\bep(?:isode)?[\s\-_]*[\(\[]?\s*(\d+)\s*[\)\]]?\b"
PATH_NUMBER = r"\b(\d{1,4})\b"
VIDEO_SUFFIXES = ["mkv", "mp4", "avi", "flv", "webm", "mov"]
MOVIE_SUFFIXES = ["mkv", "mp4", "avi", "mov"]
MIN_VIDEO_BYTES = 15 * 1024 * 1024
EXTRA_WORDS = [
    "special", "bonus", "trailer", "featurette", "recap", "sample", "extra",
    "behind the scenes", "interview",
]
EXTRA_WORDS_SPECIALS = [
    "bonus", "trailer", "featurette", "recap", "sample", "behind the scenes", "interview",
]

# --- fixed values: release attributes, first hit wins -----------------------
SOURCES = [  # pattern, source, modifier
    (r"(?i)(?:bd|blu[-_]?ray)\s*remux", "BluRay", "Remux"),
    (r"(?i)\bremux\b", "", "Remux"),
    (r"(?i)\bweb[-_]?dl\b", "WEB-DL", ""),
    (r"(?i)\bweb[-_]?rip\b", "WEBRip", ""),
    (r"(?i)\b(?:bd|blu[-_]?ray)\b", "BluRay", ""),
    (r"(?i)\bhdtv\b", "HDTV", ""),
    (r"(?i)\bdvd[-_]?rip\b", "DVD", ""),
    (r"(?i)\bdvd\b", "DVD", ""),
    (r"(?i)\bsdtv\b", "SDTV", ""),
    (r"(?i)\bcam\b", "CAM", ""),
    (r"(?i)\bts\b", "Telesync", ""),
    (r"(?i)\b60p\b", "Telecine", ""),
]
RESOLUTIONS = [
    (r"(?i)\b(?:2160p|4k|uhd)\b", "2160p"),
    (r"(?i)\b1080p\b", "1080p"),
    (r"(?i)\b720p\b", "720p"),
    (r"(?i)\b480p\b", "480p"),
    (r"(?i)\b576p\b", "576p"),
    (r"(?i)\b360p\b", "360p"),
]
MOD_DV_HDR10 = r"(?i)\bdv\s*hdr10\b"
MOD_DOLBY_VISION = r"(?i)\bdolby\s*vision\b"
MOD_HDR10PLUS = r"(?i)\bhdr10plus\b"
MOD_HDR10 = r"(?i)\bhdr10\b"
MOD_HDR = r"(?i)\bhdr\b"
EDITIONS = [
    (r"(?i)\bimax\b", "is_imax", "IMAX"),
    (r"(?i)\bextended\b", "is_extended", "Extended"),
    (r"(?i)\bdirector['’]?s\s*cut\b", "is_directors_cut", "Director's Cut"),
    (r"(?i)\bunrated\b", "is_unrated", "Unrated"),
    (r"(?i)\bremastered\b", "is_remastered", "Remastered"),
]
SPECIAL_TAGS = [
    (r"(?i)\binternal\b", "INTERNAL"),
    (r"(?i)\blimited\b", "LIMITED"),
    (r"(?i)\bproper\b", "PROPER"),
    (r"(?i)\breal\s+proper\b", "REAL"),
    (r"(?i)\brepack\b", "REPACK"),
    (r"(?i)\brerip\b", "RERIP"),
]
VIDEO_CODECS = [
    (r"(?i)\b(?:x265|hevc|h\.265)\b", "HEVC"),
    (r"(?i)\b(?:x264|avc|h\.264)\b", "AVC"),
    (r"(?i)\bav1\b", "AV1"),
]
AUDIO_CODECS = [
    (r"(?i)\b(?:ddp|dd\+|eac3)\b", "DDP"),
    (r"(?i)\b(?:ac3|dd)\b", "AC3"),
    (r"(?i)\b(?:dts)\b", "DTS"),
    (r"(?i)\b(?:truehd)\b", "TrueHD"),
    (r"(?i)\b(?:aac)\b", "AAC"),
]
AUDIO_CHANNELS = [(r"\b7\.1\b", "7.1"), (r"\b5\.1\b", "5.1"), (r"\b2\.0\b", "2.0")]
GROUP_TRAILING = r"(?i)-([a-zA-Z0-9]+)(?:\])?$"
GROUP_LEADING = r"(?i)^\[([a-zA-Z0-9]+)\]"
FORUM_QUALITY = r"(?i)\b(2160p|1080p|720p|480p|360p|4k|uhd)\b"

# --- fixed values: languages -------------------------------------------------
LANGUAGE_MULTI = r"(?i)\b(?:multi|dual[-_]?audio|multi[-_]?audio)\b"
LANGUAGES = [  # in order of priority for the primary language
    (r"(?i)\b(?:tamil|tam)\b", "ta"),
    (r"(?i)\b(?:telugu|tel)\b", "te"),
    (r"(?i)\b(?:hindi|hin)\b", "hi"),
    (r"(?i)\b(?:malayalam|mal)\b", "ml"),
    (r"(?i)\b(?:kannada|kan)\b", "kn"),
    (r"(?i)\b(?:bengali|ben)\b", "bn"),
    (r"(?i)\b(?:marathi|mar)\b", "mr"),
    (r"(?i)\b(?:english|eng)\b", "en"),
]
FORUM_LANGUAGES = [
    (r"(?i)\b(tamil|tam|ta)\b", "ta"),
    (r"(?i)\b(telugu|tel|te)\b", "te"),
    (r"(?i)\b(hindi|hin|hi)\b", "hi"),
    (r"(?i)\b(malayalam|mal|ml)\b", "ml"),
    (r"(?i)\b(kannada|kan|kn)\b", "kn"),
    (r"(?i)\b(english|eng|en)\b", "en"),
]
LANGUAGE_LABELS = {
    "ta": "Tamil 🇮🇳",
    "te": "Telugu 🇮🇳",
    "ml": "Malayalam 🇮🇳",
    "hi": "Hindi 🇮🇳",
    "kn": "Kannada 🇮🇳",
    "en": "English 🇬🇧",
    "fr": "French 🇫🇷",
    "es": "Spanish 🇪🇸",
    "de": "German 🇩🇪",
    "it": "Italian 🇮🇹",
    "ja": "Japanese 🇯🇵",
    "ko": "Korean 🇰🇷",
    "zh": "Chinese 🇨🇳",
}
LABEL_GLOBE = " 🌐"
LABEL_UNKNOWN_LANGUAGE = "Unknown 🌐"
QUALITY_BADGES = [
    (["4K", "2160P"], "🚀 4K UHD"),
    (["1080P"], "🔥 1080p HD"),
    (["720P"], "⚡ 720p HD"),
    (["480P", "SD", "360P"], "📼 SD"),
]
LABEL_OTHER_QUALITY = "🎥 "
LABEL_TITLE, LABEL_QUALITY, LABEL_AUDIO = "🎬 ", "✨ ", "🔊 "
LABEL_GROUP, LABEL_TAGS, LABEL_FOOTER = "🏷️ ", "⚡ ", "📥 Click to Stream"
LABEL_CACHED, LABEL_UNCACHED, LABEL_P2P = "⚡ RD+", "⏳ RD", "🔌 P2P"
LABEL_SIZE = "  |  💾 "
LABEL_PEER = "   |   🔊 Peer-to-Peer Stream"

# --- fixed values: quality ranks and names ----------------------------------
STORED_QUALITY_RANK = {"4K": 1, "2160P": 1, "1080P": 2, "720P": 3, "480P": 4, "SD": 5}
SHOWN_QUALITY_RANK = {"4K": 1, "2160p": 1, "1080p": 2, "720p": 3, "480p": 4, "SD": 5}
OTHER_QUALITY_RANK = 99
HEIGHT_QUALITY = {2160: "4K", 1080: "1080p", 720: "720p", 480: "480p", 576: "576p", 360: "360p"}
TEXT_QUALITY = [
    (["2160", "4k"], "4k"), (["1080"], "1080p"), (["720"], "720p"), (["480"], "480p"), (["360"], "360p"),
]
RULE_TAGS = [  # rule id, group, name, pattern
    ("hdr", "quality", "HDR", r"(?i)\bhdr\b"),
    ("dv", "quality", "DV", r"(?i)\b(?:dv|dolby[-_]?vision)\b"),
    ("1080p", "quality", "1080p", r"(?i)\b1080p\b"),
    ("720p", "quality", "720p", r"(?i)\b720p\b"),
    ("2160p", "quality", "2160p", r"(?i)\b(?:2160p|4k)\b"),
]

# --- fixed values: media types, statuses, links -----------------------------
SERIES_TYPES = ["tv", "series", "tvshow", "show"]
LINKED, PENDING = "linked", "pending_tmdb"
WATCH_STATUSES = ["active", "paused", "archived"]
TOPIC_ID = r"(?i)topic\/(\d+)"
INFOHASH = r"(?i)btih:([a-f0-9]{40})"
DOWNLOAD_STATES = [
    (["completed", "cached", "uploading", "seeding", "active", "downloaded"], "downloaded"),
    (["downloading", "metadl", "checkingresumedata", "stalled", "stalled (no seeds)", "queued"], "downloading"),
    (["error", "failed", "missingfiles", "expired"], "error"),
]
FINISHED_STATES = ["completed", "cached", "downloaded", "seeding", "uploading"]
BROKEN_STATES = ["expired", "error", "failed", "paused"]
CATALOGS = {"series": "top-series-from-forum", "hd": "tamil-hd-movies", "dubbed": "tamil-dubbed-movies"}
DETAIL_NO_NAME = "Unknown"
DETAIL_NO_OVERVIEW = "Up-to-date metadata resolving on Cinemeta."
DETAIL_PENDING = "Pending metadata match. You can link this manually in the administration rescue panel."
DETAIL_PLACEHOLDER_POSTER = ""  # configured
POSTER_FORMAT = ("https://images.metahub.space/poster/medium/", "/img")
GAP_REASONS = {
    "HEALTHY": "100% Verified Link: Both TMDB ID and IMDb ID mapped cleanly.",
    "MISSING_IMDB_GAP": "IMDb Pointer Gap: TMDB ID present, but secondary IMDb ID pointer missing.",
    "PENDING_MATCH": "Pending Matching Pool: Thread in pending_tmdb queue awaiting linking.",
    "UNLINKED": "Unlinked Thread: Thread present in storage without assigned TMDB ID.",
}
BLOCK_MARK = "cloudflare"
BLOCK_SIGNS = ["captcha", "challenge-platform", "Access denied"]
UNKNOWN_PAGE_TITLE = "Unknown Recouped Title"
FAILED_EMPTY = "Title parsing failed critically"
FAILED_INVALID = "Parsed title invalid: "
INVALID_EMPTY = "Empty title after parsing"
INVALID_METADATA = "Title consists predominantly of metadata keywords"
INVALID_YEAR = "Year out of valid range"

# --- fixed values: retention -------------------------------------------------
DOWNLOAD_CACHE_DAYS, FAILED_LOG_DAYS, LINK_CACHE_DAYS, LOCK_HOURS = 5, 7, 30, 24
WATCH_INACTIVE_DAYS = 30
RATE_LIMIT_EVENTS, RATE_LIMIT_SECONDS = 8, 60

# --- fixed values: title score ----------------------------------------------
TITLE_WEIGHT = 60.0
YEAR_EQUAL, YEAR_NEAR, YEAR_CLOSE, YEAR_UNKNOWN = 40.0, 25.0, 10.0, 20.0
DICE_FLOOR = 0.18
MATCH_THRESHOLD = 40.0
DIVERGENT_BELOW = 0.20
WINNER_BONUS, WINNER_MIN, WINNER_LEAD = 20.0, 50.0, 8.0
LOOK_ALIKES = {
    "0": "0o", "o": "0o",
    "1": "1il!", "i": "1il!", "l": "1il!",
    "3": "3e", "e": "3e",
    "4": "4a@", "a": "4a@",
    "5": "5s", "s": "5s",
    "7": "7tvl", "t": "7t", "v": "7v",
    "8": "8b", "b": "8b",
    "9": "9g", "g": "9g",
}

# --- fixed values: folded letters -------------------------------------------
FOLDED_LETTERS = {
    "a": "àáâãäåāăąǎǻα",
    "c": "çćĉċč",
    "e": "æèéêëēĕėęěε",
    "g": "ĝğġģ",
    "h": "ĥħ",
    "i": "ìíîïĩīĭįǐι",
    "j": "ĵ",
    "k": "ķĸ",
    "l": "ĺļľŀł",
    "n": "ñńņňŉŋ",
    "o": "òóôõöōŏőǒǿοω",
    "r": "ŕŗř",
    "s": "śŝşšș",
    "t": "ţťț",
    "u": "ùúûüũūŭůűųǔǖǘǚǜ",
    "w": "ŵ",
    "y": "ýÿŷ",
    "z": "źżž",
}

# spans of a title that are judged for metadata
BRACKET_PAIRS = 50
