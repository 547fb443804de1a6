"""Cleaning and plausibility of party names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.money import stripped

# Labels in front of names, ends of names, and words that only labels hold.
FRONT_LABEL = "^(?:购买方|购方|销售方|销方)?(?:名称|名|称|桥|社|祢|林|抬头)\\s*[：:]+"
NAME_ENDS = "(?:有限责任公司|股份有限公司|有限公司|研究院|勘察院|分院|中心|银行|学校|单位|个体工商户|商行|店|厂)$"
LABEL_STARTS = ("名称", "称：", "称:", "桥：", "桥:", "社：", "社:", "祢：", "祢:", "林：", "林:", "机店号", "税号", "纳税人识别号", "供货单位")
LABEL_WORDS = (
    "统一社会信用", "纳税人识别", "开户银行", "开户行", "银行账号", "地址电话", "机器编号", "校验码", "发票号码", "发票代码", "项目名称",
    "规格型号", "收款人", "复核人", "开票人", "销方开户", "供货单位", "购买方信息", "销售方信息",
)


def clean_name(c: Column) -> Column:
    """Name without white space, broken labels, a trailing remark in brackets and outer punctuation."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""), FRONT_LABEL, "")
    rest = F.regexp_extract(t, "^[一-龥]{1,3}[：:]+(.+)$", 1)
    t = F.when((rest != "") & rest.rlike(NAME_ENDS), rest).otherwise(t)
    t = F.when(t.rlike("[（(]个体工商户[）)]$"), t).otherwise(F.regexp_replace(t, "[（(][^）)]*[）)]$", ""))
    return F.regexp_replace(t, "^[：:，,。 ]+|[：:，,。 ]+$", "")


def suspicious(c: Column) -> Column:
    """True for texts that are no party's name: too short, labels, codes, banks, too few ideographs."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    starts = "^(?:" + "|".join(LABEL_STARTS) + ")"
    odd = (F.length(t) < 3) | t.rlike(starts) | t.rlike("^[0-9A-Za-z]+$") | t.rlike("|".join(LABEL_WORDS))
    odd |= t.endswith("银行") & (F.length(t) <= 8)
    odd |= F.length(F.regexp_replace(t, "[^一-鿿]", "")) < 2
    return F.when(t == "个人", False).otherwise(odd)


def reliable(field: str, c: Column) -> Column:
    """True if a value of the field can be trusted as it stands."""
    from paperloom.functions.checksum import valid_credit_code
    from paperloom.functions.money import amount

    t = stripped(c)
    base = (t != "") & (t != "待确认")
    if field in ("buyer_name", "seller_name"):
        return base & ~suspicious(t)
    if field in ("buyer_tax", "seller_tax"):
        return base & ((t == "个人无税号") | valid_credit_code(t))
    if field == "tax_rate":
        return base & ((t == "免税") | t.rlike(r"^\d{1,2}%$"))
    if field in ("pretax_amount", "tax_amount", "total_amount"):
        return base & amount(t).isNotNull()
    return base
