"""Default rule pack.

Every list below is data an operator takes as a parameter; these are the defaults.
"""

from __future__ import annotations

# Lists, words, patterns and texts that results must agree with.

TITLE_MARKERS = ("政策", "通知", "办法", "细则", "指南", "意见", "方案", "公告", "公示", "规划")

CAPTCHA_MARKERS = ("验证码", "captcha", "人机验证")
LOGIN_WORDS = ("登录", "login")
PASSWORD_WORD = "password"
FETCH_RESTRICTED_STATUSES = (401, 403, 429)
FETCH_RESTRICTED_MARKERS = ("请输入验证码", "安全验证", "访问过于频繁", "captcha")

PUBLISH_DATE_LABELS = ("发布时间", "发布日期", "印发日期")
EFFECTIVE_DATE_LABELS = ("施行日期", "生效日期")
APPLICATION_START_LABELS = ("申报开始日期", "申请开始日期")
APPLICATION_END_LABELS = ("申报截止日期", "申请截止日期")
PUBLISHER_LABELS = ("发布机关", "发布单位", "发文机关")

DATE_PATTERN = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"
DOCUMENT_NUMBER_PATTERN = r"[一-鿿A-Za-z0-9]+(?:〔|\[)20\d{2}(?:〕|\])\d+号"
ATTACHMENT_SUFFIXES = (".pdf", ".doc", ".docx")

GOVERNMENT_NAME_PHRASES = ("人民政府", "政府政策")

SUPPORT_TIERS = ((15, ("补贴", "奖励", "贴息", "专项资金")), (8, ("支持", "试点", "培育")))
SUPPORT_FLOOR = 3
LEASING_TIERS = (
    (30, ("设备采购", "设备更新", "技术改造", "扩产", "生产线", "车辆")),
    (15, ("数字化", "节能", "绿色")),
)
LEASING_FLOOR = 5

SCENARIOS = (
    "设备采购",
    "设备更新",
    "技术改造",
    "扩产",
    "生产线建设",
    "车辆更新",
    "绿色转型",
    "数字化转型",
)

PROMISE_WORDS = ("保证", "承诺", "包过", "肯定", "一定", "必然", "必将")
BENEFIT_WORDS = ("补贴", "补助", "奖励", "资金", "审批", "获批", "通过", "融资", "贷款")
AUTHORITY_WORDS = ("政府", "官方")
FINANCING_WORDS = ("融资", "贷款", "方案")
BACKSTOP_WORDS = ("兜底", "担保", "保证", "背书", "增信")
ENDORSEMENT_PHRASES = ("政府背书", "政府担保", "政府保证", "政府推荐", "政府认可", "官方背书")
DISCLAIMER = "政策解读仅供业务参考，以政策原文及主管部门解释为准；融资方案及审批结果以正式评估为准。"

PRIORITY_SHEET = "重点商机"
OBSERVATION_SHEET = "政策观察"
OBSERVATION_GRADE = "观察"
PENDING_REVIEW = "待复核"
REASON_NO_EVIDENCE = "缺少可定位的行业原文依据"
REASON_EXPIRED = "政策申报已截止"
REASON_SOURCE = "来源信息不完整"
REASON_INDUSTRY = "行业判断不明确"
REASON_SCENARIO = "缺少明确的机会场景"
REASON_TIMING_UNCLEAR = "政策时效信息不明确"
REASON_TIMING_CONFLICT = "政策日期存在矛盾"
REASON_SCRIPT = "营销话术含过度承诺或政府背书表达"
REASON_CLASSIFICATION = "标准行业分类信息不完整"
REASON_TAGS = "缺少有效业务行业标签"
REASON_ATTACHMENT = "附件解析不完整："
REASON_TRACE = "政策追溯信息不完整："
REASON_NO_OPPORTUNITY = "惠企政策未识别到可验证的机会行业"
TRACE_LABELS = {
    "title": "政策名称",
    "source_id": "来源标识",
    "source_name": "来源名称",
    "detail_url": "原文链接",
    "raw_text": "原始正文",
    "normalized_text": "规范正文",
}
FAILURE_REASON = ("AI 分析失败，需人工复核（", "）")
FAILURE_NO_DETAIL = "无错误详情"
FAILURE_SUMMARY_CHARS = 32000
LOCATION_PREFIX = "正文字符"
RETRY_NOTE = "\n\n上次输出未通过 JSON/Schema 校验，请完整重写 JSON。校验错误："

ATTACHMENT_HEADING = ("[附件 ", "：", "]\n")
ATTACHMENT_LEGACY_ERROR = ("旧版 Word .doc 附件不自动下载或解析（", "）")
ATTACHMENT_FAILED_ERROR = ("附件解析失败（", "）：")
ATTACHMENT_EMPTY_ERROR = "ValueError: 附件未提取到文本，可能需要 OCR 或人工复核"
API_NO_TEXT_ERROR = "政策详情接口未返回可解析正文"

EXPORT_HEADERS = (
    "商机等级",
    "商机评分",
    "政策名称",
    "政策摘要",
    "政策层级",
    "适用地区",
    "发布机构",
    "政策文号",
    "发布日期",
    "申报开始日期",
    "申报截止日期",
    "支持方向",
    "适用企业条件",
    "国标行业门类名称",
    "国标行业门类代码",
    "国标行业大类名称",
    "国标行业大类代码",
    "业务行业标签",
    "行业判断置信度",
    "机会场景",
    "融资租赁关联度",
    "推荐理由",
    "评分理由",
    "政策原文依据",
    "依据位置",
    "推荐动作",
    "推荐联系时间",
    "行业营销开场白",
    "风险与限制",
    "复核原因",
    "政策原文链接",
    "附件链接",
    "数据来源",
    "采集时间",
    "AI 分析时间",
    "免责声明",
)
EXPORT_LINK_HEADERS = ("政策原文链接", "附件链接")
LIST_JOINER = "、"

LEASE_TERMS = ("设备租赁", "融资租赁", "绿色租赁", "售后回租", "设备直租", "租赁")
FINANCE_TERMS = ("贴息", "担保", "信贷", "融资支持", "贷款", "再贷款")
INDUSTRY_TERMS = ("产业", "制造业", "新能源", "汽车", "化工", "医药", "装备")
ADMIN_LEVEL_SCORES = {"国家": 30, "省": 20, "市": 10}
ADMIN_LEVEL_DEFAULT = 10
CHECK_SCORES = {"pass": 10, "needs_attention": 5, "not_recommended": 0}
PRIORITY_LEVELS = ("高", "中", "低")
SCORE_DIMENSIONS = (
    "行政层级",
    "行业相关性",
    "融资信号密度",
    "政策更新频率",
    "合规可采集性",
    "域名权威性",
)
RECOMMENDATIONS = {
    "pass": "建议启用",
    "needs_attention": "需人工关注",
    "not_recommended": "不建议",
}
GOV_SUFFIX = ".gov.cn"

PHASES = ("candidate", "verified", "retired")
ORIGINS = ("manual", "discovery")
REGISTRATION_STATUSES = ("unknown", "not_required", "per_dataset", "required", "completed")
ELIGIBLE_REGISTRATION = ("not_required", "completed")
AUTHORIZATION_TYPES = ("unknown", "none", "api_key", "agreement", "written_permission")
ELIGIBLE_AUTHORIZATION = ("api_key", "agreement", "written_permission")
PLACEHOLDERS = ("", "tbd", "pending", "n/a", "none", "null")
VERSION_PLACEHOLDERS = (*PLACEHOLDERS, "unknown", "unassigned", "unregistered")
REVIEW_WINDOW_DAYS = 90

# Extraction profiles: listing selectors and content selectors per source.
EXTRACTION_PROFILES = {
    "miit": ((".page-content li",), (".ccontent", ".article", "article", "main")),
    "ndrc": ((".list li",), (".article_con", "article", "main")),
    "zhejiang_huiqi": ((), ("#policy-detail", ".policy-detail", "article", "main")),
    "zhejiang_eit": ((".default_pgContainer li",), (".article-content", "article", "main")),
    "jiangsu_government": ((".art_list li",), (".article-content", "article", "main")),
    "jiangsu_eit": ((".list-box li",), (".TRS_Editor", "article", "main")),
}
GENERIC_PROFILE = (
    ("ul.list li a", ".policy-list a", ".list-content a", ".govlist a", "a"),
    (".content", ".article", "#zoom", ".TRS_Editor", "article", "main"),
)

PROMPT_PLACEHOLDERS = (
    "{{document_text}}",
    "{{industry_catalog}}",
    "{{business_tags}}",
    "{{json_schema}}",
)
PROMPT_BLANK_ERROR = "用户提示词模板不能为空"

SCHEMA_VERSION = 1
BATCH_FILE_GLOB = "policy-batch-*.json"
BATCH_FOLDER_GLOB = "policy-batch-*"
LISTING_PAGE_CAP = 20
DEFAULT_WINDOW_DAYS = 30
