"""Chat sessions as two tables: sessions (session_id, title, title_custom, created_at, updated_at) and messages (message_id, session_id, role, text)."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLE = 72


def collapsed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" "))


def sessions(sessions_: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with turn_count, the number of user messages (0 without any), the last changed first."""
    turns = messages.groupBy("session_id").agg(F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("turn_count"))
    out = sessions_.join(turns, "session_id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))
    return out.orderBy(F.desc("updated_at"), F.desc("session_id"))


def detail(sessions_: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their messages in order."""
    rows = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("message_id", "role", "text"))).alias("messages"))
    return sessions_.join(rows, "session_id", "left")


def valid_messages(messages: DataFrame) -> DataFrame:
    """Messages of a user or an assistant, the only roles that are stored."""
    return messages.where(F.col("role").isin("user", "assistant"))


def renamed(sessions_: DataFrame, session_id: str, title: str) -> DataFrame:
    name = " ".join(title.split())
    if not 1 <= len(name) <= 100:
        raise ValueError("a title has 1 to 100 characters")
    this = F.col("session_id") == session_id
    return sessions_.withColumns({"title": F.when(this, F.lit(name)).otherwise(F.col("title")), "title_custom": F.when(this, F.lit(True)).otherwise(F.col("title_custom"))})


def deleted(sessions_: DataFrame, messages: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a session; its messages go with it."""
    return sessions_.where(F.col("session_id") != session_id), messages.where(F.col("session_id") != session_id)


def appended(sessions_: DataFrame, messages: DataFrame, exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """exchanges: session_id, question, answer, message_id (of the question; the answer's is one more), created_at. Sessions without messages or title of
    their own are named after their first question. Exchanges of unknown sessions are dropped, as are ones whose message_id is there already.
    """
    known = exchanges.join(sessions_.select("session_id"), "session_id", "left_semi").join(messages.select("message_id"), "message_id", "left_anti")
    new = known.select("message_id", "session_id", F.lit("user").alias("role"), F.col("question").alias("text")).unionByName(known.select((F.col("message_id") + 1).alias("message_id"), "session_id", F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    first = titles(known.withColumnRenamed("question", "text").withColumn("role", F.lit("user"))).join(messages.select("session_id").distinct(), "session_id", "left_anti").withColumnRenamed("title", "_title")
    last = known.groupBy("session_id").agg(F.max("created_at").alias("_at"))
    out = sessions_.join(first, "session_id", "left").join(last, "session_id", "left")
    title = F.when(F.col("title_custom") | F.col("_title").isNull(), F.col("title")).otherwise(F.col("_title"))
    out = out.withColumns({"title": title, "updated_at": F.coalesce("_at", "updated_at")}).select(*sessions_.columns)
    return out, messages.select("message_id", "session_id", "role", "text").unionByName(new)


def titles(messages: DataFrame) -> DataFrame:
    """session_id, title: the first question of each session, white space collapsed, cut."""
    asked = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by("text", "message_id").alias("t"))
    return asked.select("session_id", F.substring(collapsed(F.col("t")), 1, TITLE).alias("title"))


#: Title of a session without messages, and the text of a run without an answer.
NEW_TITLE = "Cuộc trò chuyện mới"
NO_ANSWER = "Lượt chạy chưa tạo được câu trả lời."
SESSION_ID = re.compile(r"[0-9a-f]{32}")
EVENTS = "session_id string, kind string, title string, question string, answer string, run_id string, result_json string, at long"


class ChatStore:
    """Sessions and messages as a log of events below a folder, appended and never rewritten; tables are what the log comes to.

    A session is there from its create to its delete. Its title is the last rename's, or else its first question's, or else NEW_TITLE.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._exists = lambda: path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _events(self) -> DataFrame:
        rows = self.spark.read.schema(EVENTS).parquet(self.folder) if self._exists() else self.spark.createDataFrame([], EVENTS)
        gone = rows.where("kind = 'delete'").select("session_id").distinct()
        return rows.join(gone, "session_id", "left_anti")

    def _put(self, session_id: str, kind: str, **values: str) -> None:
        row = {"session_id": session_id, "kind": kind, "at": time.time_ns() // 1000} | values
        self.spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(self.folder)

    def _known(self, session_id: str) -> None:
        if not isinstance(session_id, str) or not SESSION_ID.fullmatch(session_id):
            raise ValueError("not a session id")
        if self._events().where((F.col("session_id") == session_id) & (F.col("kind") == "create")).isEmpty():
            raise KeyError("no such session")

    def create(self) -> str:
        session_id = uuid.uuid4().hex
        self._put(session_id, "create", title=NEW_TITLE)
        return session_id

    def rename(self, session_id: str, title: str) -> None:
        name = " ".join(title.split()) if isinstance(title, str) else ""
        if not 1 <= len(name) <= 100:
            raise ValueError("a title has 1 to 100 characters")
        self._known(session_id)
        self._put(session_id, "rename", title=name)

    def delete(self, session_id: str) -> None:
        self._known(session_id)
        self._put(session_id, "delete")

    def append(self, session_id: str, question: str, run_id: str, answer: str | None, result_json: str) -> None:
        """A question and the run that answered it, as two messages that appear together."""
        if not isinstance(question, str) or not question.strip() or not isinstance(run_id, str) or not SESSION_ID.fullmatch(run_id):
            raise ValueError("an exchange has a question and a finished run")
        json.loads(result_json)
        self._known(session_id)
        self._put(session_id, "exchange", question=question.strip(), answer=NO_ANSWER if answer is None else answer, run_id=run_id, result_json=result_json)

    def messages(self) -> DataFrame:
        """message_id, session_id, role, text, run_id, result_json, created_at; a question comes before its answer."""
        rows = self._events().where("kind = 'exchange'")
        none = F.lit(None).cast("string")
        asked = rows.select((F.col("at") * 2).alias("message_id"), "session_id", F.lit("user").alias("role"), F.col("question").alias("text"), none.alias("run_id"), none.alias("result_json"), "at")
        told = rows.select((F.col("at") * 2 + 1).alias("message_id"), "session_id", F.lit("assistant").alias("role"), F.col("answer").alias("text"), "run_id", "result_json", "at")
        return asked.unionByName(told).withColumn("created_at", F.timestamp_micros("at")).drop("at")

    def sessions(self) -> DataFrame:
        """session_id, title, title_custom, created_at, updated_at, turn_count; the last changed first."""
        e = self._events()
        last = lambda column, kind: F.max_by(F.when(F.col("kind") == kind, F.col(column)), F.when(F.col("kind") == kind, F.col("at")))
        first = F.min_by(F.when(F.col("kind") == "exchange", F.col("question")), F.when(F.col("kind") == "exchange", F.col("at")))
        rows = e.groupBy("session_id").agg(
            last("title", "rename").alias("_own"),
            F.substring(collapsed(first), 1, TITLE).alias("_first"),
            F.timestamp_micros(F.min("at")).alias("created_at"),
            F.timestamp_micros(F.max("at")).alias("updated_at"),
            F.count_if(F.col("kind") == "exchange").alias("turn_count"),
            F.bool_or(F.col("kind") == "create").alias("_made"),
        )
        out = rows.where("_made").select("session_id", F.coalesce("_own", "_first", F.lit(NEW_TITLE)).alias("title"), F.col("_own").isNotNull().alias("title_custom"), "created_at", "updated_at", "turn_count")
        return out.orderBy(F.desc("updated_at"), F.desc("session_id"))

    def get(self, session_id: str) -> dict:
        """A session with its messages in order, results as they were given."""
        self._known(session_id)
        head = self.sessions().where(F.col("session_id") == session_id).first().asDict()
        rows = self.messages().where(F.col("session_id") == session_id).orderBy("message_id").collect()
        messages = [r.asDict() | {"result": json.loads(r["result_json"]) if r["result_json"] else None} for r in rows]
        return head | {"messages": [{k: v for k, v in m.items() if k not in ("result_json", "session_id")} for m in messages]}
