"""Account rules over tables: registration, login, claims; and the password hash."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T

MIN_PASSWORD, MAX_PASSWORD = 8, 128
#: Rounds of a password's hash.
ITERATIONS = 100_000
#: $ also stands before a final line feed, but before no other line end: (?d).
USERNAME = r"(?d)^[A-Za-z0-9_-]{3,20}$"
STATUS = {"Validation": 400, "Conflict": 409, "NotFound": 404, "Unauthorized": 401}


def registration_error(username: Column, password: Column, taken: Column) -> Column:
    """Code of the first rule that fails; null if none does."""
    size = T.utf16_length(F.coalesce(password, F.lit("")))
    return (
        F.when(size < MIN_PASSWORD, "User.PasswordTooShort")
        .when(size > MAX_PASSWORD, "User.PasswordTooLong")
        .when(~F.coalesce(username.rlike(USERNAME), F.lit(False)), "User.InvalidUsername")
        .when(taken, "User.UsernameTaken")
    )


def error_type(code: Column) -> Column:
    return F.when(code == "User.UsernameTaken", "Conflict").when(code == "User.InvalidCredentials", "Unauthorized").when(code == "User.NotFound", "NotFound").when(code.isNotNull(), "Validation")


def http_status(kind: Column) -> Column:
    """Status of an error type; 500 for others, 200 for none."""
    out = F.when(kind.isNull(), F.lit(200))
    for name, code in STATUS.items():
        out = out.when(kind == name, F.lit(code))
    return out.otherwise(F.lit(500))


def register(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """attempts (attempt_id, username, password) with normalized, error and status.

    A name is taken by a user, or by an earlier attempt of the batch that succeeds.
    """
    known = users.select(F.col("normalized_username").alias("known")).distinct()
    rows = attempts.withColumn("normalized", T.normalised_name(F.col("username"))).join(known, F.col("normalized") == F.col("known"), "left")
    rows = rows.withColumn("rule", registration_error(F.col("username"), F.col("password"), F.col("known").isNotNull()))
    turn = F.row_number().over(Window.partitionBy("normalized", F.col("rule").isNull()).orderBy("attempt_id"))
    rows = rows.withColumn("error", F.when(F.col("rule").isNull() & (turn > 1), "User.UsernameTaken").otherwise(F.col("rule")))
    return rows.select(*attempts.columns, "normalized", "error", F.when(F.col("error").isNull(), 201).otherwise(http_status(error_type(F.col("error")))).alias("status"))


def insert(users: DataFrame, registered: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """users with the accepted attempts appended, with hashed passwords; names that exist are left out, as a unique index would.

    Ids go on after the largest one in the order of the attempts, with gaps, as those of a sequence.
    """
    last = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    fresh = registered.filter("error IS NULL").join(users.select(F.col("normalized_username").alias("normalized")), "normalized", "left_anti")
    fresh = fresh.crossJoin(F.broadcast(last))  # one row
    fresh = fresh.select((F.col("__last") + 1 + F.col("attempt_id")).cast(users.schema["id"].dataType).alias("id"), "username", F.col("normalized").alias("normalized_username"), hashed(iterations)(F.col("password")).alias("password_hash"))
    return users.unionByName(fresh, allowMissingColumns=True)


def login(attempts: DataFrame, users: DataFrame, matches=None) -> DataFrame:
    """attempts (attempt_id, username, password) with error and status; matches(password, hash) is a Column function, by default verified.

    An unknown name gives the same answer as a wrong password; with the default it costs the same check,
    against a hash of nobody's: a Python function runs on every row.
    """
    matches = verified if matches is None else matches
    known = users.select(F.col("normalized_username").alias("known"), "password_hash")
    rows = attempts.join(known, T.normalised_name(F.col("username")) == F.col("known"), "left")
    long = T.utf16_length(F.coalesce(F.col("password"), F.lit(""))) > MAX_PASSWORD
    ok = ~long & matches(F.col("password"), F.coalesce("password_hash", F.lit(NOBODY))) & F.col("known").isNotNull()
    error = F.when(~F.coalesce(ok, F.lit(False)), "User.InvalidCredentials")
    return rows.select(*attempts.columns, error.alias("error"), http_status(error_type(error)).alias("status"))


def claims(user_id: Column, name: Column) -> Column:
    """struct<id,name> if the id is digits that fit an int and the name isn't empty, else null."""
    number = F.when(user_id.rlike(r"^[0-9]+$"), user_id.try_cast("int"))
    return F.when(number.isNotNull() & (F.coalesce(F.length(name), F.lit(0)) > 0), F.struct(number.alias("id"), name.alias("name")))


def with_normalised_name(users: DataFrame) -> DataFrame:
    """The second migration: a normalised name for each user."""
    return users.withColumn("normalized_username", T.normalised_name(F.col("username")))


def hash_password(password: str, salt: bytes | None = None, iterations: int = ITERATIONS) -> str:
    """PBKDF2-SHA512 with its parameters, base64."""
    salt = os.urandom(16) if salt is None else salt
    key = hashlib.pbkdf2_hmac("sha512", password.encode(), salt, iterations, 32)
    return base64.b64encode(b"\x01" + struct.pack(">III", 2, iterations, len(salt)) + salt + key).decode()


def verify_password(password: str, stored: str) -> bool:
    """Whether the password has this hash; malformed hashes match nothing."""
    try:
        raw = base64.b64decode(stored, validate=True)
        kind, iterations, size = struct.unpack(">III", raw[1:13])
    except (ValueError, struct.error):
        return False
    if raw[0] != 1 or kind != 2 or size < 16 or len(raw) < 13 + size + 16:
        return False
    key = raw[13 + size :]
    return hmac.compare_digest(key, hashlib.pbkdf2_hmac("sha512", password.encode(), raw[13 : 13 + size], iterations, len(key)))


def hashed(iterations: int = ITERATIONS) -> Callable[[Column], Column]:
    """The column function that hashes passwords with a salt each."""

    @F.pandas_udf("string")
    def run(passwords: pd.Series) -> pd.Series:
        return passwords.map(lambda p: None if p is None else hash_password(p, iterations=iterations))

    return run


def verified(password: Column, stored: Column) -> Column:
    """Whether the password has this hash; null and over-long ones have none."""

    @F.pandas_udf("boolean")
    def run(passwords: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([p is not None and len(p) <= MAX_PASSWORD and verify_password(p, h) for p, h in zip(passwords, hashes, strict=True)], dtype=bool)

    return run(password, stored)


#: A hash that an unknown name's password is held against.
NOBODY = hash_password("", bytes(16))
