"""Settings shared by all operators.

Every word list the operators use sits here and can be replaced per run by
building another :class:`Settings`.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values. They must be equal to the catalog's known conventions for the
# results to be right.
# ---------------------------------------------------------------------------

# Text markers of an entity source file.
ENTITY_MARKERS = ("@Table(", "javax.persistence")

# Public fields of the shared base entity: column, field, type, key, comment.
BASE_ENTITY_COLUMNS = (
    ("id", "id", "Long", True, "主键id"),
    ("site_id", "siteId", "Integer", False, "区域id"),
    ("created_by", "createdBy", "Integer", False, "创建人ID"),
    ("created_name", "createdName", "String", False, "创建人"),
    ("created_account", "createdAccount", "String", False, "创建人账户"),
    ("date_created", "dateCreated", "Date", False, "新增时间"),
    ("modified_by", "modifiedBy", "Integer", False, "更新人ID"),
    ("modified_name", "modifiedName", "String", False, "更新人"),
    ("modified_account", "modifiedAccount", "String", False, "更新人账户"),
    ("date_modified", "dateModified", "Date", False, "更新时间"),
    ("aggregator", "aggregator", "Integer", False, "集成商ID"),
    ("aggregator_name", "aggregatorName", "String", False, "集成商名称"),
    ("operation", "operation", "String", False, "数据来源(URL)"),
)

# Column names that flag a deleted row, and names that hold a tenant.
SOFT_DELETE_NAMES = ("deleted", "is_deleted", "del_flag", "is_del", "is_active")
DIMENSION_NAMES = (
    "shipper",
    "shipper_id",
    "party_id",
    "seller_party_id",
    "aggregator",
    "tenant_id",
    "org_id",
)

# Soft-delete columns whose "live" value is 1 instead of 0.
ACTIVE_FLAG_NAMES = ("is_active",)

# Table name prefix to business domain.
DOMAIN_MAP = {
    "pcl_packet_": "01-pcl",
    "pcl_": "01-pcl",
    "act_": "02-act",
    "sys_": "03-sys",
    "dmn_": "03-sys",
    "member_": "03-sys",
    "cms_": "03-sys",
    "tz_": "04-tz",
    "king_dee_": "04-tz",
    "eto_": "05-eto",
    "eto_kr_": "05-eto",
    "wms_": "05-eto",
    "trk_": "06-trk",
    "shopify_": "06-trk",
    "amazon_": "06-trk",
    "temu_": "06-trk",
    "oms_": "06-trk",
    "b2c_": "06-trk",
}

# Prefixes tried, in this order, when `<x>_id` is matched to a table.
RELATION_PREFIXES = ("pcl_", "act_", "sys_")

# Source type (lower case) to normalized type.
TYPE_NAMES = {
    "string": "string",
    "varchar": "string",
    "char": "string",
    "integer": "integer",
    "int": "integer",
    "short": "integer",
    "long": "long",
    "bigdecimal": "decimal",
    "double": "decimal",
    "float": "decimal",
    "boolean": "boolean",
    "date": "date",
    "datetime": "datetime",
    "timestamp": "datetime",
    "localdatetime": "datetime",
    "text": "text",
    "clob": "text",
    "byte[]": "blob",
    "blob": "blob",
}

# Words before a parenthesis that are never an enum constant.
NOT_A_CONSTANT = ("class", "enum", "interface", "void", "return")
NOT_A_TENANT_CONSTANT = NOT_A_CONSTANT + ("get", "getStatus", "getMessageByStatus")

# Source types and name parts of a column that may hold enum codes.
CODE_TYPES = ("Short", "Integer", "short", "int")
CODE_NAME_PARTS = ("status", "state", "type")

# Fields that never are columns.
SKIPPED_FIELDS = ("serialVersionUID",)

# Result limits.
SEARCH_LIMIT = 10
CANDIDATE_LIMIT = 3
RELATION_LIMIT = 20

# Width, in characters, of the comment look-back in compatible mode.
COMMENT_WINDOW = 300

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Names, maps and switches of one run.

    ``compat=True`` keeps historic quirks (comments leaking from the field
    before, enum kind decided on commented-out text, tenant columns counted
    anywhere in a statement) instead of their corrected forms.
    """

    markers: tuple[str, ...] = ENTITY_MARKERS
    base_entity: str = "BaseEntity"
    base_columns: tuple[tuple, ...] = BASE_ENTITY_COLUMNS
    soft_delete_names: tuple[str, ...] = SOFT_DELETE_NAMES
    dimension_names: tuple[str, ...] = DIMENSION_NAMES
    domain_map: dict[str, str] = field(default_factory=lambda: dict(DOMAIN_MAP))
    default_domain: str = "other"
    relation_prefixes: tuple[str, ...] = RELATION_PREFIXES
    relation_suffix: str = "_id"
    relation_to_column: str = "id"
    enum_dir: str = "dict"
    bundle_stem: str = "messages_zh_CN"
    rule_id: str = "tkmybatis"
    compat: bool = False

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULTS = Settings()
