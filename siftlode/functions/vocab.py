"""Word lists, patterns, weights and enumerations that results must agree on."""

from __future__ import annotations

# Categories and their output file keys.
FILE_KEYS = {"小说": "novel", "漫画": "comic", "有声": "audio", "影视": "video", "下载": "download", "其他": "other", "失效": "invalid"}

# Default search word of each category.
SEARCH_WORDS = {"小说": "斗破苍穹", "漫画": "鬼灭之刃", "有声": "凡人修仙传", "影视": "庆余年", "下载": "三体", "其他": "斗破苍穹", "失效": "斗破苍穹"}

# Keywords that mark a category in a name or group.
KEYWORDS = {
    "漫画": ("漫画", "动漫", "comic", "manga", "manhua", "acg", "dmzj", "webtoon", "kuaikan", "快看", "哔哩漫画", "腾讯动漫", "看漫画", "动漫之家", "漫客栈", "有妖气", "动漫屋", "风之动漫", "古风漫画", "韩漫", "日漫", "国漫"),
    "小说": ("小说", "文学", "阅读", "笔趣", "起点", "纵横", "晋江", "番茄", "七猫", "书城", "novel", "book", "txt", "笔趣阁", "全本", "完本", "看书", "书吧", "书坊", "书屋", "书阁", "书斋", "书苑", "典籍", "经典", "文库", "追书", "搜书", "淘书", "掌阅", "多看", "豆瓣阅读", "微信读书", "蜗牛"),
    "有声": ("有声", "听书", "音频", "FM", "电台", "广播剧", "猫耳", "喜马拉雅", "懒人听书", "mp3", "m4a", "audio", "倾听", "聆听", "播客", "podcast"),
    "影视": ("影视", "电影", "电视", "剧集", "视频", "短剧", "影院", "动漫番剧", "m3u8", "mp4", "video", "tv", "movie", "vod", "放映", "点播", "观影", "看片"),
    "下载": ("下载", "epub", "pdf", "azw3", "mobi", "文件", "书仓", "藏书", "离线", "下载站", "txt下载", "全本下载", "网盘"),
}

# Media marks in rules and url templates: (category, weight, tag, pattern).
MEDIA_MARKS = (
    ("影视", 20, "video", r"m3u8|mp4|\.flv|video|vod|\.ts(?:[^a-z0-9_]|\z)"),
    ("有声", 20, "audio", r"mp3|m4a|\.aac|audio|listen|听"),
    ("漫画", 12, "image", r"img|image|comic|漫画图片|图片章节|\.jpg|\.png|\.webp|插图"),
    ("下载", 15, "download", r"epub|pdf|azw3|mobi|download|下载|文件"),
)
DEAD_MARKS = "失效|已死|挂掉|不可用|死了|废弃"

# Name cleaning.
QUALITY_WORDS = r"(?:优\+*|可用|修复|推荐|新站|备用|失效|需登录|暂不可用|已失效|校验超时|恢复|维护中|测试|调试|首发|正版|纯净|无广告|需VIP|已恢复|广告)"
ANNOTATIONS = r"(?:生肉|熟肉|连载中|已完结|完本|连载|完结|太监|断更|停更|\d+[集话章])"
QUALITY_LABELS = (r"优\+\+\+", r"优\+\+", r"优\+", "优质", "已校验", "已失效", "已恢复", "需登录", "需VIP", "需付费", "暂不可用", "维护中", "校验超时", "导", "导入", "外部")
FANCY_SYMBOLS = "【】『』「」《》〈〉"

# What marks a name as not clean.
DIRTY_QUALITY = r"(?:优\+*|可用|修复|推荐|新站|备用|失效|需登录|暂不可用|已校验)"

# Code points of Extended_Pictographic, as ranges of hexadecimal numbers.
PICTOGRAPHIC = r"""
\x{a9}\x{ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21a9}-\x{21aa}\x{231a}-\x{231b}\x{2328}
\x{23cf}\x{23e9}-\x{23f3}\x{23f8}-\x{23fa}\x{24c2}\x{25aa}-\x{25ab}\x{25b6}\x{25c0}\x{25fb}-\x{25fe}
\x{2600}-\x{2604}\x{260e}\x{2611}\x{2614}-\x{2615}\x{2618}\x{261d}\x{2620}\x{2622}-\x{2623}\x{2626}\x{262a}
\x{262e}-\x{262f}\x{2638}-\x{263a}\x{2640}\x{2642}\x{2648}-\x{2653}\x{265f}-\x{2660}\x{2663}\x{2665}-\x{2666}
\x{2668}\x{267b}\x{267e}-\x{267f}\x{2692}-\x{2697}\x{2699}\x{269b}-\x{269c}\x{26a0}-\x{26a1}\x{26a7}
\x{26aa}-\x{26ab}\x{26b0}-\x{26b1}\x{26bd}-\x{26be}\x{26c4}-\x{26c5}\x{26c8}\x{26ce}-\x{26cf}\x{26d1}
\x{26d3}-\x{26d4}\x{26e9}-\x{26ea}\x{26f0}-\x{26f5}\x{26f7}-\x{26fa}\x{26fd}\x{2702}\x{2705}\x{2708}-\x{270d}
\x{270f}\x{2712}\x{2714}\x{2716}\x{271d}\x{2721}\x{2728}\x{2733}-\x{2734}\x{2744}\x{2747}\x{274c}\x{274e}
\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2764}\x{2795}-\x{2797}\x{27a1}\x{27b0}\x{27bf}\x{2934}-\x{2935}
\x{2b05}-\x{2b07}\x{2b1b}-\x{2b1c}\x{2b50}\x{2b55}\x{3030}\x{303d}\x{3297}\x{3299}\x{1f004}\x{1f02c}-\x{1f02f}
\x{1f094}-\x{1f09f}\x{1f0af}-\x{1f0b0}\x{1f0c0}\x{1f0cf}-\x{1f0d0}\x{1f0f6}-\x{1f0ff}\x{1f170}-\x{1f171}
\x{1f17e}-\x{1f17f}\x{1f18e}\x{1f191}-\x{1f19a}\x{1f1ae}-\x{1f1e5}\x{1f201}-\x{1f20f}\x{1f21a}\x{1f22f}
\x{1f232}-\x{1f23a}\x{1f23c}-\x{1f23f}\x{1f249}-\x{1f25f}\x{1f266}-\x{1f321}\x{1f324}-\x{1f393}
\x{1f396}-\x{1f397}\x{1f399}-\x{1f39b}\x{1f39e}-\x{1f3f0}\x{1f3f3}-\x{1f3f5}\x{1f3f7}-\x{1f3fa}
\x{1f400}-\x{1f4fd}\x{1f4ff}-\x{1f53d}\x{1f549}-\x{1f54e}\x{1f550}-\x{1f567}\x{1f56f}-\x{1f570}
\x{1f573}-\x{1f57a}\x{1f587}\x{1f58a}-\x{1f58d}\x{1f590}\x{1f595}-\x{1f596}\x{1f5a4}-\x{1f5a5}\x{1f5a8}
\x{1f5b1}-\x{1f5b2}\x{1f5bc}\x{1f5c2}-\x{1f5c4}\x{1f5d1}-\x{1f5d3}\x{1f5dc}-\x{1f5de}\x{1f5e1}\x{1f5e3}
\x{1f5e8}\x{1f5ef}\x{1f5f3}\x{1f5fa}-\x{1f64f}\x{1f680}-\x{1f6c5}\x{1f6cb}-\x{1f6d2}\x{1f6d5}-\x{1f6e5}
\x{1f6e9}\x{1f6eb}-\x{1f6f0}\x{1f6f3}-\x{1f6ff}\x{1f7da}-\x{1f7ff}\x{1f80c}-\x{1f80f}\x{1f848}-\x{1f84f}
\x{1f85a}-\x{1f85f}\x{1f888}-\x{1f88f}\x{1f8ae}-\x{1f8af}\x{1f8bc}-\x{1f8bf}\x{1f8c2}-\x{1f8cf}
\x{1f8d9}-\x{1f8ff}\x{1f90c}-\x{1f93a}\x{1f93c}-\x{1f945}\x{1f947}-\x{1f9ff}\x{1fa58}-\x{1fa5f}
\x{1fa6e}-\x{1faff}\x{1fc00}-\x{1fffd}
""".replace("\n", "")
LEGACY_EMOJI = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{27BF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}"
INVISIBLE = r"\x{FE00}-\x{FE0F}\x{200B}-\x{200F}\x{FEFF}"

# Host prefixes that name the same site.
HOST_PREFIXES = ("www.", "m.", "wap.", "mobile.", "read.", "api.", "app.", "h5.")

# Weights of what speaks for a category: type known or not, keyword, group, type and keyword at one.
VOTES = {"type": 18, "no_type": 2, "keyword": 18, "group": 10, "type_and_keyword": 20}

# Scripted rules, by how hard they are to follow.
COMPLEX_JS = ("<js>", "@js:", r"java\.ajax", r"source\.getKey", r"source\.login", r"\bcookie\b", r"\bcache\b", r"\beval\b", "Reload", "WebView")
INSPECT_JS = ("<js>", "@js:", r"java\.ajax", r"source\.getKey", "eval", "WebView")

# Request headers that are never sent on.
UNSAFE_HEADERS = ("host", "content-length", "connection", "proxy-authorization", "authorization", "cookie", "x-forwarded-for", "x-forwarded-host", "x-real-ip", "x-auth-token", "x-api-key")

# Scores.
AVAILABILITY_SCORE = {"usable": 100, "probably_usable": 70, "complex_unverified": 40}
AVAILABILITY_PENALTY = {"dead": 100, "invalid": 100, "timeout": 30, "forbidden": 10}
AVAILABILITY_RANK = {"usable": 0, "probably_usable": 1, "complex_unverified": 2, "login_related": 3, "needs_login": 3, "forbidden": 4, "timeout": 5, "unknown": 6, "dead": 7, "invalid": 8}
POINTS = {
    "connect_ok": 30,
    "search_http_ok": 30,
    "search_rule_likely_ok": 20,
    "enabled": 10,
    "enabled_explore": 5,
    "has_search_url": 10,
    "has_rule_search_booklist": 10,
    "has_rule_search_name": 8,
    "has_rule_search_bookurl": 8,
    "has_rule_bookinfo_name": 8,
    "has_rule_toc_chapterlist": 8,
    "has_rule_content_content": 8,
    "respond_time_high": -20,
    "last_update_old": -10,
    "classification_high": 5,
    "name_contains_dead": -40,
    "group_contains_dead": -40,
    "missing_search_url": -20,
    "missing_rule_search": -20,
    "missing_rule_content": -20,
    "needs_login": -10,
    "complex_js_eval": -20,
    "complex_js_dynamic": -10,
    "complex_js_static": -5,
}
RESPOND_BONUS = ((500, 20), (1000, 18), (2000, 15), (3000, 12), (5000, 8), (10000, 4), (20000, 2))
UPDATE_BONUS = ((7, 20), (30, 15), (90, 10), (180, 5), (365, 2))
WEIGHT_BONUS = ((10000, 10), (5000, 8), (1000, 5), (100, 2), (0, 0))

# Reasons written for each dedupe level.
DEDUPE_REASON = {
    "exact": "exact URL match",
    "url": "normalized URL match",
    "conservative": "conservative: same normalized URL + category + type",
    "host": "same host (host-level dedup)",
    "aggressive": "aggressive: same host + name",
}

# What a record's owner is advised to look at, by stage of the chain and reason.
SUGGESTIONS = {
    ("search", "list_empty"): "The list rule selects nothing on the result page; compare it with the page's markup.",
    ("search", "book_url_missing"): "No item gives a link; the link rule runs inside an item and may lack its @href.",
    ("bookInfo", "name_empty"): "The title rule selects no text on the detail page.",
    ("bookInfo", "no_toc_url"): "No link to the contents was found, so the detail page itself is taken for them.",
    ("toc", "list_empty"): "The chapter list rule selects nothing on the contents page.",
    ("toc", "chapter_url_missing"): "Chapters have no links; where a script makes them, only a browser sees them.",
    ("content", "content_too_short"): "The text rule gives next to nothing; the page may ask for a login, a captcha or a payment.",
    ("content", "short"): "The text has fewer than 100 characters; look whether the chapter is short or cut off.",
}

# Modes of validation.
VALIDATE_MODES = ("fast", "standard", "deep")
