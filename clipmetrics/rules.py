"""These tables and patterns define the results and are stated as they are."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: commerce-intent score -------------------------------------------------
PLATFORM_WEIGHTS = {
    "xiaohongshu": 1.00,
    "kuaishou": 0.96,
    "douyin": 0.95,
    "weishi": 0.86,
    "meipai": 0.78,
    "weibo": 0.74,
    "toutiao": 0.72,
    "haokan": 0.64,
    "xigua": 0.60,
    "bilibili": 0.58,
    "acfun": 0.46,
}
UNKNOWN_PLATFORM_WEIGHT = 0.5
INTENT_TERMS = [
    "好物", "种草", "开箱", "测评", "评测", "推荐", "实用", "新品", "爆款", "神器", "必买", "平替", "性价比", "清单",
    "review", "unbox", "đáng mua", "nên mua", "giá tốt", "tiện ích",
]
# (upper bound in seconds, fit); unknown duration and anything longer have their own value
DURATION_FIT = [(90, 1.0), (180, 0.88), (300, 0.65)]
DURATION_FIT_UNKNOWN = 0.55
DURATION_FIT_LONG = 0.40

# --- fixed values: topic expansion (markers -> phrases) -----------------------------------
EXPANSION_RULES = [
    (["đồ bếp", "nha bep", "nhà bếp", "kitchen"],
     ["厨房好物", "厨房神器", "懒人厨房", "备餐神器"]),
    (["tẩy rửa", "ve sinh", "vệ sinh", "cleaning", "làm sạch"],
     ["清洁好物", "厨房清洁神器", "去污神器", "去油污"]),
    (["đồ gia dụng", "gia dung", "home", "life hack", "tiện ích"],
     ["居家好物", "生活好物", "实用好物", "提升幸福感好物"]),
    (["meal prep", "bảo quản", "bao quan", "đông lạnh", "dong lanh"],
     ["备餐", "冻门", "保鲜神器", "保鲜盒", "真空袋"]),
    (["cà phê", "ca phe", "coffee"],
     ["户外咖啡", "便携咖啡", "手冲咖啡", "咖啡好物"]),
    (["camping", "cắm trại", "cam trai", "outdoor"],
     ["露营好物", "户外好物", "户外装备", "便携好物"]),
    (["pet", "thú cưng", "thu cung", "mèo", "meo", "chó", "cho"],
     ["猫咪迷惑行为", "狗狗迷惑行为", "宠物搞笑", "宠物配音", "猫咪日常", "狗狗日常", "宠物好物", "养猫好物", "养狗好物", "宠物用品"]),
    (["skincare", "chăm sóc cá nhân", "cham soc ca nhan", "personal care", "mỹ phẩm", "my pham", "makeup"],
     ["美妆好物", "平价好物", "新品试用", "好物测评"]),
    (["công nghệ", "cong nghe", "technology", "tech", "đồ công nghệ", "do cong nghe", "gadget", "điện tử", "dien tu", "số hóa", "so hoa"],
     ["科技好物", "数码好物", "实用数码产品", "黑科技好物", "数码新品开箱"]),
    (["ai agent", "agent ai"],
     ["AI智能体", "智能体", "人工智能Agent"]),
    (["microservice", "micro service", "vi dịch vụ"],
     ["微服务", "微服务架构", "分布式系统", "服务拆分"]),
]

# --- fixed values: sources ----------------------------------------------------------------
PUBLIC_SOURCES = ["kuaishou", "xiaohongshu", "weibo", "xigua", "haokan", "toutiao", "acfun", "meipai", "weishi"]
ALL_SOURCES = ["acfun", "bilibili", "douyin", "haokan", "kuaishou", "meipai", "toutiao", "weibo", "weishi", "xiaohongshu", "xigua"]


@dataclass(frozen=True)
class HostRule:
    """Accepted addresses of one platform: host suffixes, a path pattern, a required parameter."""

    suffixes: tuple[str, ...]
    path: str
    param: str = ""


# --- fixed values: accepted addresses per platform ----------------------------------------
HOST_RULES = {
    "xiaohongshu": HostRule(("xiaohongshu.com",), r"(?i)/explore/|/discovery/item/"),
    "weibo": HostRule(("weibo.com",), r"(?i)/tv/show/|^/*[0-9]+/[0-9A-Za-z]+/*$"),
    "xigua": HostRule(("ixigua.com",), r"^/*[0-9]{8,}/*$"),
    "haokan": HostRule(("haokan.baidu.com",), r"(?i)^/v/*$", "vid"),
    "toutiao": HostRule(("toutiao.com",), r"(?i)/video/"),
    "acfun": HostRule(("acfun.cn",), r"(?i)/v/ac"),
    "meipai": HostRule(("meipai.com",), r"(?i)/media/"),
    "weishi": HostRule(("weishi.qq.com",), r"(?i)/t/|/video/"),
}
PREVIEW_HOSTS = {
    "bilibili": ("bilibili.com", "b23.tv"),
    "douyin": ("douyin.com", "iesdouyin.com"),
    "kuaishou": ("kuaishou.com", "gifshow.com"),
    "xiaohongshu": ("xiaohongshu.com", "xhslink.com"),
    "weibo": ("weibo.com", "weibo.cn"),
    "xigua": ("ixigua.com",),
    "haokan": ("haokan.baidu.com",),
    "toutiao": ("toutiao.com",),
    "acfun": ("acfun.cn",),
    "meipai": ("meipai.com",),
    "weishi": ("weishi.qq.com",),
}
TRACKING_PARAMS = ["spm", "from", "source"]
TRACKING_PREFIX = "utm_"
REDIRECT_HOST = "duckduckgo.com"
REDIRECT_PARAM = "uddg"

# --- fixed values: page patterns ----------------------------------------------------------
ANCHOR = r"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""
TAG = r"(?is)<[^>]+>"
META_TAG = r"(?is)<meta\s+[^>]*>"
META_ATTR = r"""(?is)([a-zA-Z_:.-]+)\s*=\s*["']([^"']*)["']"""
VIDEO_SRC = r"""(?is)<video\b[^>]*\bsrc=["']([^"']+)["']"""
HTTP_URL = r"""https?://[^"'<>\\\s]+"""
MEDIA_MARKERS = [".mp4", "douyinvod", "mime_type=video", "/play/"]
CAPTURE_MARKERS = ["douyinvod.com", "mime_type=video", "/aweme/v1/play/", ".mp4"]
NOTE_VIDEO = r'(?is)"type"\s*:\s*"video"|"noteType"\s*:\s*"video"|"originVideoKey"\s*:|"media"\s*:\s*\{\s*"stream"'
NOTE_IMAGE = r'(?is)"type"\s*:\s*"normal"|"noteType"\s*:\s*"normal"'
GENERIC_TITLES = ["登录", "login", "首页", "home -", "安全验证", "验证码", "你的生活兴趣社区"]
SITE_SUFFIXES = [" - 抖音", "_抖音", " | 抖音", "- 抖音"]

DOUYIN_ID = r"(?i)/video/([0-9]{8,})"
DOUYIN_DOWNLOAD_ID = r"(?i)/(?:share/)?video/([0-9]{8,})"
DOUYIN_MODAL_ID = r"(?i)(?:[?&]|\b)modal_id=([0-9]{8,})"
DOUYIN_ANCHOR = r"""(?is)<a\b[^>]*href\s*=\s*["'][^"']*(?:https?://www\.douyin\.com)?/video/([0-9]{8,})[^"']*["'][^>]*>(.*?)</a>"""
DOUYIN_EMBEDDED_ID = r"""(?i)\\?["'](?:aweme_id|awemeId)\\?["']\s*[:=]\s*\\?["']([0-9]{8,})\\?["']"""
DOUYIN_URL = "https://www.douyin.com/video/"
KUAISHOU_ID = r"(?i)(?:https?://www\.kuaishou\.com)?/short-video/([a-z0-9]+)"
KUAISHOU_ANCHOR = r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']*/short-video/[a-z0-9]+[^"']*)["'][^>]*>(.*?)</a>"""
KUAISHOU_URL = "https://www.kuaishou.com/short-video/"
BILIBILI_URL = "https://www.bilibili.com/video/"
NEARBY_TEXT = {
    "title": r"""(?s)\\?["']desc\\?["']\s*:\s*\\?"([^"\\]*(?:\\.[^"\\]*)*)\\?\"""",
    "author": r"""(?s)\\?["']nickname\\?["']\s*:\s*\\?"([^"\\]*(?:\\.[^"\\]*)*)\\?\"""",
}
NEARBY_NUMBER = {
    "views": "play_count",
    "likes": "digg_count",
    "comments": "comment_count",
    "shares": "share_count",
    "create_time": "create_time",
    "duration": "duration",
}
NEARBY_BEFORE, NEARBY_AFTER = 3000, 14000
NOTE_BEFORE, NOTE_AFTER = 4096, 350000
LOGIN_STATUS = 2483
STATE_PATTERNS = [
    r"(?s)window\.INIT_STATE\s*=\s*(\{.*?\})\s*;?\s*</script>",
    r"(?s)window\.__APOLLO_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>",
]
PHOTO_URL = r"""(?s)["']photoUrl["']\s*:\s*["']((?:\\.|[^"'\\])+)["']"""
MAIN_URLS = r"""(?s)["']mainMvUrls["']\s*:\s*\[(.*?)\]"""
LIST_URL = r"""(?s)["']url["']\s*:\s*["']((?:\\.|[^"'\\])+)["']"""
PLAY_KEYS = ["play_addr", "play_addr_h264", "play_addr_265"]
PLAY_RATIOS = ["1080p", "720p", "540p", "default"]
PLAY_TEMPLATE = ("https://aweme.snssdk.com/aweme/v1/play/?video_id=", "&ratio=", "&line=0")

# --- fixed values: jobs -------------------------------------------------------------------
RESUMABLE = ["queued", "downloading", "localizing", "rendering"]
RUNNING = [*RESUMABLE, "aspect_rendering"]
FAILED = ["failed", "localization_failed"]
MODES = ["download", "subtitles", "dub", "ocr_music", "ocr_subtitles"]
ASPECTS = ["original", "16:9", "3:4", "9:16", "1:1"]
CHANNEL_MODES = ["channel", "creator", "author", "uploader"]
STYLES = {
    "": "clean", "clean": "clean", "ocr_clean": "clean", "ocr_overlay": "clean",
    "capsule": "capsule", "ocr_capsule": "capsule", "box": "box", "ocr_box": "box",
}
INTERRUPTED = "aspect render was interrupted by restart; run that aspect export again"
JOB_TIMEOUT_MINUTES = 180

# --- fixed values: media ------------------------------------------------------------------
ASPECT_TARGETS = {"16:9": (1920, 1080), "3:4": (1080, 1440), "9:16": (1080, 1920), "1:1": (1080, 1080)}
SAMPLE_RATIOS = {
    1: [0.50],
    2: [0.33, 0.67],
    3: [0.22, 0.50, 0.78],
    4: [0.16, 0.38, 0.62, 0.84],
    5: [0.12, 0.31, 0.50, 0.69, 0.88],
}
MAX_SUBTITLE_BYTES = 2 << 20
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
