"""Word lists, labels and scores that results depend on."""

from __future__ import annotations

# Header names (lower case) of each canonical column.
COLUMN_ALIASES = {
    "article_id": ("article_id", "article_file_id", "id", "文章id", "资讯id"),
    "title": ("title", "article_title", "文章标题", "标题"),
    "publish_time": ("publish_time", "article_publish_time", "publish_date", "date", "发布日期", "发布时间", "时间"),
    "source": ("source", "article_source", "source_site", "来源网站", "来源", "媒体"),
    "content": ("content", "正文文本", "正文", "文章内容", "文本"),
    "trading_code": ("trading_code", "证券代码", "股票代码"),
    "entity": ("entity", "secu_abbr", "实体", "公司", "关联企业", "事件关联企业"),
    "industry_code": ("industry_code", "行业代码"),
    "industry": ("industry", "industry_name", "行业", "板块"),
    "event_label": ("event", "event_label", "event_name", "事件", "事件类型", "事件类型名称"),
    "polarity_label": ("polarity", "event_polarity", "polarity_label", "event_emotion", "事件情感正负面", "情感", "影响方向"),
    "impact_analysis": ("impact_analysis", "event_impact_analysis", "事件影响分析", "影响分析"),
    "duplicate_flag": ("duplicate_flag", "重复性标志", "是否重复", "重复标志"),
    "duplication_id": ("duplication_id", "重复组id"),
}

# Sheet names and the task of their rows.
SHEET_SCOPES = {"个股新闻": "company_event", "行业新闻": "industry_event", "个股重复新闻": "company_duplicate", "行业重复新闻": "industry_duplicate"}

# Legal forms at the end of a company's name, longest first.
LEGAL_FORMS = ("股份有限公司", "有限责任公司", "有限公司", "集团股份", "集团", "公司")

# Polarity labels, synonyms and words.
POSITIVE, NEGATIVE, NEUTRAL = "正面", "负面", "中性"
POSITIVE_NAMES = ("positive", "pos", "利好")
NEGATIVE_NAMES = ("negative", "neg", "利空")
POSITIVE_WORDS = ("利好", "增长", "突破", "中标", "盈利", "增持", "通过", "获批")
NEGATIVE_WORDS = ("处罚", "违规", "亏损", "下滑", "诉讼", "问询", "立案", "退市", "减持", "风险")

# Words of each event type, in the order in which types are tried.
EVENT_WORDS = {
    "监管处罚": ("处罚", "违规", "监管", "立案", "问询函", "关注函"),
    "重大诉讼": ("诉讼", "仲裁", "起诉", "判决"),
    "财务造假": ("财务造假", "虚增", "虚假记载", "会计差错"),
    "退市风险": ("退市", "ST", "暂停上市"),
    "业绩预告": ("业绩", "净利润", "营收", "亏损", "增长"),
    "股权质押": ("质押", "解除质押", "冻结"),
    "高管变动": ("董事长", "总经理", "辞职", "任命", "高管"),
    "技术突破": ("专利", "研发", "突破", "获批", "临床"),
    "供应链变化": ("供应", "订单", "中标", "采购", "客户"),
    "政策影响": ("政策", "补贴", "关税", "限产", "监管办法"),
}
NO_EVENT = "无事件"
NO_EVENT_LABELS = ("无事件", "无", "其他", "未识别")

# Words of each kind of source in the order in which kinds are tried, with the kind's name and score.
SOURCE_KINDS = (
    ("official", "官方", 1.00, ("证监会", "上交所", "深交所", "北交所", "交易所", "监管")),
    ("company", "公司", 0.90, ("公司公告", "官方网站", "官网", "年报", "半年报", "季报", "公告")),
    ("mainstream", "主流财经媒体", 0.75, ("证券时报", "上海证券报", "中国证券报", "证券日报", "财新", "第一财经")),
    ("general", "综合媒体", 0.55, ("新华社", "人民日报", "央视", "经济日报")),
    ("self_media", "自媒体", 0.35, ("雪球", "股吧", "自媒体", "公众号")),
)
UNKNOWN_SOURCE, UNKNOWN_SCORE = "未知来源", 0.35

# Severity of event types, in the order in which they are tried.
SEVERITY = {
    "财务造假": 0.95, "退市风险": 0.95, "监管处罚": 0.78, "重大诉讼": 0.72, "业绩预告": 0.55, "股权质押": 0.50,
    "高管变动": 0.42, "技术突破": 0.40, "供应链变化": 0.58, "政策影响": 0.62, "其他事件": 0.35,
}
DEFAULT_SEVERITY = 0.35

# Weights of the five parts of credibility, and of the five factors of a pair's similarity.
CREDIBILITY_WEIGHTS = {"source_authority": 0.30, "multi_source_consistency": 0.25, "official_endorsement": 0.25, "content_completeness": 0.10, "recency_score": 0.10}
PAIR_WEIGHTS = {"text": 0.35, "entity": 0.25, "event_type": 0.15, "time": 0.15, "tokens": 0.10}

# Alert levels.
HIGH_CREDIBILITY, MEDIUM_CREDIBILITY, HIGH_SEVERITY, MEDIUM_SEVERITY = 0.75, 0.45, 0.65, 0.35
HIGH_RISK_LEVELS = ("高风险", "高价值机会", "高关注", "待核实重点关注")

# Words of the evidence lifecycle.
SUPPORT_WORDS = ("确认", "属实", "正式", "决定书", "问询函", "立案", "处罚")
REFUTE_WORDS = ("澄清", "不实", "否认", "辟谣", "失实")
ESCALATION_WORDS = ("扩大", "升级", "持续发酵", "新增损失", "进一步影响")
RESOLUTION_WORDS = ("处置完成", "结案", "执行完毕", "恢复正常", "风险解除")

# Feedback kinds and their diagnoses.
DIAGNOSES = {
    "wrong_type": "EVENT_TYPE_ERROR", "wrong_polarity": "POLARITY_ERROR", "over_merge": "COREFERENCE_OVER_MERGE",
    "missed_merge": "COREFERENCE_MISSED_MERGE", "wrong_credibility": "CREDIBILITY_ERROR",
}
OTHER_DIAGNOSIS = "DOMAIN_EDGE_CASE"

# What ends the harmless part of a reviewer's note, and words that are no trigger.
NOTE_MARKERS = ("被误判", "误判为", "识别成", "应识别为", "应为", "不是")
NOTE_STOP_WORDS = ("事件", "错误", "误判", "识别", "调整")

# Words that give a made-up sample away.
GIVEAWAYS = ("事件类型", "分类标签", "该标签", "本文属于")
