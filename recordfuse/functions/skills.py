"""Skills: a dictionary of names, matching in text, canonical forms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import constant_map
from ..udfs.wratio import best_match, clean, wratio
from .text import trimmed

#: Canonical name, then its other names.
VOCABULARY = {
    "Python": ("python", "py"),
    "Java": ("java",),
    "JavaScript": ("javascript", "js", "ecmascript", "es6", "es2015", "es2020"),
    "TypeScript": ("typescript", "ts"),
    "Go": ("go", "golang"),
    "Rust": ("rust",),
    "C++": ("c++", "cpp", "c plus plus"),
    "C#": ("c#", "csharp", "c sharp"),
    "C": ("c language",),
    "Ruby": ("ruby",),
    "PHP": ("php",),
    "Swift": ("swift",),
    "Kotlin": ("kotlin",),
    "Scala": ("scala",),
    "R": ("r language", "r programming"),
    "MATLAB": ("matlab",),
    "Perl": ("perl",),
    "Shell": ("bash", "shell", "sh", "zsh", "fish shell"),
    "Dart": ("dart",),
    "React": ("react", "reactjs", "react.js"),
    "Vue.js": ("vue", "vuejs", "vue.js"),
    "Angular": ("angular", "angularjs", "angular.js"),
    "Svelte": ("svelte",),
    "HTML": ("html", "html5"),
    "CSS": ("css", "css3"),
    "Sass": ("sass", "scss"),
    "Next.js": ("next.js", "nextjs", "next js"),
    "Nuxt.js": ("nuxt.js", "nuxtjs"),
    "Redux": ("redux",),
    "jQuery": ("jquery",),
    "Node.js": ("node", "node.js", "nodejs"),
    "Django": ("django",),
    "Flask": ("flask",),
    "FastAPI": ("fastapi", "fast api"),
    "Spring": ("spring", "spring boot", "springboot"),
    "Express": ("express", "expressjs", "express.js"),
    "Rails": ("rails", "ruby on rails"),
    "Laravel": ("laravel",),
    "ASP.NET": ("asp.net", "asp net", "aspnet"),
    "PostgreSQL": ("postgresql", "postgres", "pg"),
    "MySQL": ("mysql",),
    "SQLite": ("sqlite",),
    "MongoDB": ("mongodb", "mongo"),
    "Redis": ("redis",),
    "Cassandra": ("cassandra",),
    "Elasticsearch": ("elasticsearch", "elastic search", "es"),
    "DynamoDB": ("dynamodb", "dynamo db"),
    "Neo4j": ("neo4j",),
    "Oracle": ("oracle", "oracle db", "oracle database"),
    "SQL": ("sql", "structured query language"),
    "AWS": ("aws", "amazon web services", "amazon aws"),
    "GCP": ("gcp", "google cloud", "google cloud platform"),
    "Azure": ("azure", "microsoft azure"),
    "Heroku": ("heroku",),
    "Vercel": ("vercel",),
    "Netlify": ("netlify",),
    "Docker": ("docker",),
    "Kubernetes": ("kubernetes", "k8s"),
    "Terraform": ("terraform",),
    "Ansible": ("ansible",),
    "Jenkins": ("jenkins",),
    "GitHub Actions": ("github actions", "github ci"),
    "GitLab CI": ("gitlab ci", "gitlab ci/cd"),
    "CI/CD": ("ci/cd", "ci cd", "continuous integration", "continuous delivery"),
    "Linux": ("linux", "unix"),
    "Nginx": ("nginx",),
    "Apache": ("apache",),
    "Machine Learning": ("machine learning", "ml"),
    "Deep Learning": ("deep learning", "dl"),
    "NLP": ("nlp", "natural language processing"),
    "Computer Vision": ("computer vision", "cv", "image recognition"),
    "PyTorch": ("pytorch", "torch"),
    "TensorFlow": ("tensorflow", "tf"),
    "Keras": ("keras",),
    "scikit-learn": ("scikit-learn", "sklearn", "scikit learn"),
    "Pandas": ("pandas",),
    "NumPy": ("numpy",),
    "Matplotlib": ("matplotlib",),
    "Spark": ("spark", "apache spark", "pyspark"),
    "Hadoop": ("hadoop", "apache hadoop"),
    "Kafka": ("kafka", "apache kafka"),
    "Airflow": ("airflow", "apache airflow"),
    "dbt": ("dbt", "data build tool"),
    "Tableau": ("tableau",),
    "Power BI": ("power bi", "powerbi"),
    "REST API": ("rest api", "rest", "restful", "restful api"),
    "GraphQL": ("graphql", "graph ql"),
    "gRPC": ("grpc", "g rpc"),
    "WebSockets": ("websockets", "websocket"),
    "Jest": ("jest",),
    "Pytest": ("pytest",),
    "JUnit": ("junit",),
    "Cypress": ("cypress",),
    "Selenium": ("selenium",),
    "Git": ("git",),
    "GitHub": ("github",),
    "GitLab": ("gitlab",),
    "Bitbucket": ("bitbucket",),
    "Microservices": ("microservices", "microservice"),
    "Event-Driven": ("event-driven", "event driven"),
    "Serverless": ("serverless",),
    "Agile": ("agile", "scrum", "kanban"),
}
FUZZY_LEAST = 80.0

#: Key in lower case to canonical name, in the dictionary's order.
KEYS: dict[str, str] = {key: name for name, others in VOCABULARY.items() for key in (name.lower(), *others)}
CANONICAL = tuple(VOCABULARY)


def _quoted(key: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in key)


def _alternatives(ends: list[str]) -> str:
    """A pattern for what is left of keys: common beginnings are tried once, and the longest that fits is taken."""
    heads = sorted({e[0] for e in ends if e})
    if not heads:
        return ""
    tails = [_quoted(h) + _alternatives([e[1:] for e in ends if e[:1] == h]) for h in heads]
    return "(?:" + "|".join(tails) + ")" + ("?" if "" in ends else "")


def _dealt(keys: list[str], n: int = 5) -> str:
    """The same by groups of first letters, so that most words are passed over after a look at each group."""
    heads = sorted({k[0] for k in keys})
    groups = [heads[i : i + n] for i in range(0, len(heads), n)]
    return "(?:" + "|".join(f"(?=[{''.join(map(_quoted, g))}]){_alternatives([k for k in keys if k[0] in g])}" for g in groups) + ")"


_LEFT, _RIGHT = r"(?<![a-z0-9_])", r"(?![a-z0-9_])"
PATTERN = f"{_LEFT}({_dealt(list(KEYS))}){_RIGHT}"
#: The same without taking the characters, so that every place where a key begins gives its longest.
PLACES = f"{_LEFT}(?=({_dealt(list(KEYS))}){_RIGHT})"
#: Names of a key and of the shorter ones that fit where it begins.
BEGINNINGS = {long: [name for key, name in KEYS.items() if re.match(re.escape(key) + _RIGHT, long)] for long in KEYS}


def _map() -> Column:
    return constant_map(KEYS)


def find_skills(c: Column) -> Column:
    """Canonical names in the order in which the text has them: longest match from the left, without overlap."""
    found = F.regexp_extract_all(F.lower(c), F.lit(PATTERN), F.lit(1))
    return F.coalesce(F.array_distinct(F.transform(F.array_distinct(found), lambda k: F.element_at(_map(), k))), F.array().cast("array<string>"))


def scan_skills(c: Column) -> Column:
    """Canonical names of all keys that occur, one inside another too, in the dictionary's order."""
    longest = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(PLACES), F.lit(1)))
    found = F.flatten(F.transform(longest, lambda k: F.element_at(constant_map(BEGINNINGS), k)))
    return F.coalesce(F.array_intersect(F.array(*map(F.lit, CANONICAL)), found), F.array().cast("array<string>"))


def exact_skill(c: Column) -> Column:
    return F.try_element_at(_map(), F.lower(trimmed(c)))


@F.pandas_udf(T.StringType())
def _fuzzy(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: best_match(x, CANONICAL, FUZZY_LEAST), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def fuzzy_score(raw: pd.Series, canonical: pd.Series) -> pd.Series:
    """How alike a raw skill and a canonical name are, both in lower case, 0 to 100."""
    return pd.Series([0.0 if a is None or b is None else wratio(clean(a), b.lower()) for a, b in zip(raw, canonical, strict=True)], dtype="float64")


def canonical_skill(c: Column, fuzzy: bool = True) -> Column:
    """The dictionary's name; with ``fuzzy`` the most alike where there is none, sent to Python only then."""
    exact = exact_skill(c)
    return F.coalesce(exact, _fuzzy(F.when(exact.isNull() & (trimmed(c) != ""), c))) if fuzzy else exact


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fuzzy_each(raw: pd.Series) -> pd.Series:
    return raw.map(lambda xs: [x and best_match(x, CANONICAL, FUZZY_LEAST) for x in xs], na_action="ignore")


def canonical_each(c: Column, fuzzy: bool = True) -> Column:
    """``canonical_skill`` of each of a list, in its place. Python runs outside the list's functions, on lists that need it."""
    exact = F.transform(c, exact_skill)
    if not fuzzy:
        return exact
    rest = F.transform(c, lambda x: F.when(exact_skill(x).isNull() & (trimmed(x) != ""), x))
    found = _fuzzy_each(F.when(F.exists(rest, lambda x: x.isNotNull()), rest))
    return F.when(found.isNull(), exact).otherwise(F.zip_with(exact, found, lambda a, b: F.coalesce(a, b)))


def canonical_skills(c: Column, fuzzy: bool = True) -> Column:
    """Of a list: names without the unknown, each once, in order."""
    return F.array_distinct(F.array_compact(canonical_each(c, fuzzy)))
