"""Users, roles and permissions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_contains
from .filters import same_as

# Fixed value: the status code of an active user.
ACTIVE_USER = "SUS10"

# The role that holds every active permission, and the permission
# names the other roles hold.
ALL_PERMISSIONS_ROLE = "Super Admin"
ROLE_GRANTS: Mapping[str, Sequence[str]] = {
    "Pharmacy Manager": (
        "VIEW_DASHBOARD",
        "VIEW_PHARMACIES",
        "EDIT_PHARMACIES",
        "VIEW_ANALYTICS",
        "VIEW_PATIENT_ADHERENCE",
        "VIEW_REFILL_PREDICTIONS",
        "USE_SUPPORT_CHAT",
        "VIEW_REPORTS",
        "EXPORT_DATA",
        "VIEW_BIR_MONITORING",
    ),
    "Data Analyst": (
        "VIEW_DASHBOARD",
        "VIEW_PHARMACIES",
        "VIEW_ANALYTICS",
        "VIEW_PATIENT_ADHERENCE",
        "VIEW_REFILL_PREDICTIONS",
        "VIEW_REPORTS",
        "EXPORT_DATA",
        "USE_SUPPORT_CHAT",
    ),
    "Support Staff": (
        "VIEW_DASHBOARD",
        "VIEW_PHARMACIES",
        "USE_SUPPORT_CHAT",
        "VIEW_BIR_MONITORING",
    ),
    "Viewer": (
        "VIEW_DASHBOARD",
        "VIEW_PHARMACIES",
    ),
}


def active_roles(roles: DataFrame) -> DataFrame:
    return (
        roles.where(F.col("IsActive") == 1)
        .select("RoleID", "RoleName", "RoleDescription", "IsActive")
        .orderBy("RoleName", "RoleID")
    )


def role_permission_matrix(
    roles: DataFrame,
    permissions: DataFrame,
    grants: Mapping[str, Sequence[str]] = ROLE_GRANTS,
    all_role: str = ALL_PERMISSIONS_ROLE,
) -> DataFrame:
    """Which role holds which permission.

    Each permission lists the roles that hold it, in one pass over the
    permissions; the roles then join by name. No product of the two tables is
    formed.
    """
    holders = [F.when(F.col("IsActive") == 1, all_role)]
    holders += [
        F.when(F.col("PermissionName").isin(list(names)), role) for role, names in grants.items()
    ]
    granted = permissions.select(
        "PermissionID",
        "PermissionName",
        F.explode(F.array_compact(F.array(*holders))).alias("RoleName"),
    )
    return granted.join(roles.select("RoleID", "RoleName"), "RoleName").select(
        "RoleID", "RoleName", "PermissionID", "PermissionName"
    )


def user_permissions(
    users: DataFrame,
    roles: DataFrame,
    role_permissions: DataFrame,
    permissions: DataFrame,
    username: str | None = None,
) -> DataFrame:
    """The permissions of each active user, or of one user.

    Users are grouped by name first; permissions are put together for each set of roles
    that occurs, and joined to the names once, so no row needs to be removed again.
    """
    people = users.where(F.col("StatusUDC") == ACTIVE_USER)
    if username is not None:
        people = people.where(same_as(users, "Username", username))
    held = (
        role_permissions.where(F.col("IsActive") == 1)
        .select("RoleID", "PermissionID")
        .join(roles.where(F.col("IsActive") == 1).select("RoleID"), "RoleID")
        .join(
            permissions.where(F.col("IsActive") == 1).select(
                "PermissionID", "PermissionName", "PermissionDescription", "Module"
            ),
            "PermissionID",
        )
        .select("RoleID", "PermissionName", "PermissionDescription", "Module")
        .distinct()
    )
    names = people.groupBy("Username").agg(F.sort_array(F.collect_set("RoleID")).alias("_roles"))
    of_set = (
        names.select("_roles")
        .distinct()
        .select("_roles", F.explode("_roles").alias("RoleID"))
        .join(held, "RoleID")
        .select("_roles", "PermissionName", "PermissionDescription", "Module")
        .distinct()
    )
    return names.join(of_set, "_roles").select(
        "Username", "PermissionName", "PermissionDescription", "Module"
    )


def users_with_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    """All users with their role, newest first."""
    return (
        users.join(roles.select("RoleID", "RoleName", "RoleDescription"), "RoleID", "left")
        .select(
            "Userid",
            "Username",
            "Email",
            "Firstname",
            "Lastname",
            "Status",
            "StatusUDC",
            "IsSuperAdmin",
            "CreatedDate",
            "UpdatedDate",
            "RoleName",
            "RoleDescription",
        )
        .orderBy(F.col("CreatedDate").desc_nulls_last(), "Userid")
    )


def search_users(users: DataFrame, roles: DataFrame, term: str = "") -> DataFrame:
    """The user list narrowed by a case-insensitive substring of names, user
    name, e-mail or role. An empty term keeps every user."""
    listed = users_with_roles(users, roles)
    if not term:
        return listed
    columns = ["Firstname", "Lastname", "Username", "Email", "RoleName"]
    return listed.where(any_contains([F.col(name) for name in columns], term))


def dashboard_counts(stores: DataFrame, users: DataFrame) -> DataFrame:
    """Stores and active users in one row.

    Both tables feed one aggregate, so neither a product nor a second job is
    needed.
    """
    marks = stores.select(F.lit("store").alias("kind")).unionByName(
        users.where(F.col("StatusUDC") == ACTIVE_USER).select(F.lit("user").alias("kind"))
    )
    return marks.agg(
        F.count_if(F.col("kind") == "store").alias("pharmacies"),
        F.count_if(F.col("kind") == "user").alias("users"),
    )
