"""The scam-risk rubric: values that scoring, grading and messages refer to."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# They must equal the source rubric for results to agree.
# ---------------------------------------------------------------------------

# Keyword groups and their terms.
RISK_KEYWORDS = {
    "transfer": ["安全账户", "监管账户", "资金清查", "解冻费", "保证金", "手续费"],
    "software": ["zoom", "腾讯会议", "钉钉", "瞩目", "屏幕共享", "投屏", "远程控制"],
    "identity": ["公安局", "检察院", "银监会", "疾控中心", "客服", "专员"],
    "threat": ["冻结账户", "涉嫌犯罪", "影响征信", "黑名单", "逮捕"],
    "lure": ["配合调查", "证明清白", "验证身份", "资产证明"],
}

# Scam types in rubric order (the position is the type number).
SCAM_TYPES = [
    "冒充公检法及政府机关类",
    "刷单返利类",
    "虚假网络投资理财类",
    "冒充电商物流客服类",
    "贷款、代办信用卡类",
    "虚假征信类",
    "虚假购物、服务类",
    "冒充领导、熟人类",
    "网络游戏产品虚假交易类",
    "网黑案件（裸聊敲诈）",
]

# Names of the five human risk levels.
LEVEL_NAMES = {1: "低风险", 2: "较低风险", 3: "中等风险", 4: "较高风险", 5: "高风险"}

# Bands of the weighted kappa, best first, with their lower bounds.
QWK_BANDS = [(0.8, "优秀"), (0.6, "良好"), (0.4, "中等"), (0.2, "一般")]
QWK_LOWEST_BAND = "较差"

# metric, bound of the top grade, bound of the middle grade, is higher better
GRADE_BOUNDS = [
    ("qwk", 0.8, 0.6, True),
    ("mae", 0.5, 1.0, False),
    ("high_risk_recall", 0.9, 0.8, True),
    ("fpr_low_risk", 0.05, 0.1, False),
    ("high_risk_macro_f1", 0.8, 0.6, True),
    ("low_risk_macro_f1", 0.8, 0.6, True),
]

# Cost of predicting a level (column) for a human level (row), both from 1 to 5.
COSTS = [
    [0, 1, 2, 4, 8],
    [1, 0, 1, 3, 6],
    [2, 1, 0, 2, 4],
    [1, 2, 1, 0, 1],
    [2, 3, 2, 1, 0],
]

# Advice for the rating tiers 1-2, 3-4 and 5.
ADVICE = {
    "low": "建议提高警惕，核实信息，但无需过度担忧。",
    "middle": (
        "保持冷静，切勿提供个人信息或进行支付，可尝试进一步核实对方身份。"
        "建议通过官方渠道（如拨打官方客服电话）进行确认。"
    ),
    "high": (
        "立即中断对话，并联系官方渠道（如直接拨打银行或警察的官方电话核实），"
        "不要进行任何操作。如果已经被骗，立即报警并保存相关证据。"
    ),
}

# Chat callback protocol.
PLATFORMS = ["RESTAPI", "Web", "Android", "iOS", "Windows", "Mac", "iPad", "Unknown"]
AFTER_SEND = "C2C.CallbackAfterSendMsg"
BEFORE_SEND = "C2C.CallbackBeforeSendMsg"
TEXT_ELEMENT = "TIMTextElem"
REJECT_NO_APP = "SdkAppid missing"
REJECT_BAD_APP = "Invalid SdkAppid"
REJECT_PLATFORM = "Invalid OptPlatform"
REJECT_BODY = "Missing or invalid JSON content"

# Text shown to chat users: reasoning, level and advice go into the notice.
NOTICE_FORMAT = "---\n注意：%s\n可疑程度：%s\n建议：%s\n---"
ALERT_FORMAT = "管理员提醒：你在和%s的聊天中对方发送了可疑消息。\n%s"
ALERT_SYNC_MACHINE = 2
ALERT_FORBID = ["ForbidBeforeSendMsgCallback", "ForbidAfterSendMsgCallback"]

# Page records and the evidence document.
NO_TITLE = "无标题"
UNKNOWN_ERROR = "未知错误"
FETCH_FAILED = "访问失败: "
EVIDENCE_HEAD = "\n原始文本：\n%s\n\n初步分析：\n%s\n\n网页内容分析：\n"
EVIDENCE_PAGE = "\nURL: %s\n标题: %s\n内容摘要: %s...\n"
EVIDENCE_FAILED = "\nURL: %s\n访问状态: 失败 - %s\n"
PAGE_CHARS = 2000
EVIDENCE_CHARS = 500

# Names of the workflow steps.
STEP_NAMES = {1: "初步语义分析", 2: "URL提取", 3: "网页内容获取", 4: "综合反欺诈分析"}
STEP_FAILED = {1: "步骤1-初步分析失败: ", 4: "步骤4-综合分析失败: "}
EMPTY_REPLY = "模型返回空结果"

# URL-like substrings as the original pattern finds them. The last group is
# literal there, so the path of a link is practically never part of a match.
URL_COMPAT = r"\b(https?://)?([-A-Za-z0-9_]+\.)?[-A-Za-z0-9_]+\.[-A-Za-z0-9_]{2,63}(/-A-Za-z0-9_*)*\b"  # noqa: E501
URL_MIN_CHARS = 4

# Signs of each scam type, by type number, as the guideline names them.
SCAM_SIGNS = {
    1: ["公安局", "检察院", "法院", "银监会", "疾控中心", "洗钱", "资产清查", "证明清白", "逮捕"],
    2: ["做任务", "刷单", "返利", "操作失误", "补单"],
    3: ["股票", "期货", "虚拟货币", "高收益", "内幕消息", "投资群"],
    4: ["淘宝", "京东", "顺丰", "订单异常", "快递丢失", "退款"],
    5: ["无抵押", "低利率", "放款", "贷款", "解冻费", "保证金", "刷流水"],
    6: ["征信", "注销网贷", "央行", "监管账户", "资金证明"],
    7: ["超低价", "先付款", "优惠活动", "抽奖"],
    8: ["领导", "同事", "应急"],
    9: ["游戏装备", "皮肤", "激活费", "代练", "账号交易"],
    10: ["裸聊", "私密照片", "公开照片", "通讯录"],
}

# ---------------------------------------------------------------------------
# Own design: the sources above give no weights.
# ---------------------------------------------------------------------------

# Weight of one matched term, and the lowest score of the levels 2 to 5.
GROUP_WEIGHTS = {"transfer": 3, "software": 2, "identity": 1, "threat": 2, "lure": 1}
LEVEL_FLOORS = {2: 1, 3: 2, 4: 4, 5: 6}

# A whole link: any number of host labels, port, path, query and fragment.
URL_FULL = (
    r"\b(?:https?://)?(?:[-A-Za-z0-9_]+\.)+[-A-Za-z0-9_]{2,63}(?::[0-9]{1,5})?"
    r"(?:[/?#][-A-Za-z0-9_.~:/?#@!$&'()*+,;=%]*)?"
)
