"""Column expressions that tell pages that stand in front of a text, or in its place, from the text itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import part

# Parts of addresses and phrases of pages that ask for a login, for proof of a human, for a country, or that report a failure.
LOGIN_PATHS = ["/signin", "/sign-in", "/login", "/accounts/login", "/member/login", "/passport/login", "/login.aspx", "/auth/login", "/logon"]
LOGIN_PHRASES = [
    "登录/注册", "验证码登录", "获取短信验证码", "密码登录", "请登录", "点击登录", "立即登录", "sign in to continue", "please sign in", "please log in",
    "log in to continue", "sign in to view", "log in to view", "login to view", "you must be logged in", "please login",
]
LOGIN_HINTS = ["sign in", "log in", "password", "username", "忘记密码", "登录"]
PROOF_PATHS = [
    "/antispider", "/anti-spider", "/captcha", "/checkcaptcha", "/verifycode", "/__cf_chl", "/_sec/verify", "/check_account", "/risk", "/tbui",
]
PROOF_PHRASES = [
    "此验证码用于确认", "请输入验证码", "安全验证", "人机验证", "访问验证", "请完成验证", "您的访问出错了", "verifycode", "checkcode",
    "please verify you are a human", "verify you are human", "verifying you are human", "checking your browser", "are you a robot",
    "checking if the site connection is secure", "enable javascript and cookies to continue", "please enable cookies", "unusual traffic", "access denied",
    "request blocked", "blocked your request", "captcha-delivery.com", "enter the captcha", "solve the captcha", "attention required", "just a moment",
]
FAILURE_PHRASES = [
    "try reloading", "try again later", "please try again", "something went wrong", "this page isn't working", "an error occurred", "an error has occurred",
    "please wait...", "please wait…", "temporarily unavailable", "service temporarily unavailable", "too many requests", "rate limit exceeded",
    "request rate limit exceeded", "please wait while we verify", "页面加载失败", "加载失败", "请稍后重试", "网络异常", "访问过于频繁", "请求过于频繁",
    "服务暂时不可用", "请稍候再试",
]
COUNTRY_PHRASES = [
    "choose a country", "select your country", "select your region", "shopping in the u.s.", "choose your country", "country selector", "region selector",
]
PROOF_CHARS, FAILURE_CHARS = 1500, 600
# How the error of a page begins, and the kind of page that it implies.
ERROR_KINDS = {
    "js_shell": ["js_shell_detected", "obfuscated_payload"], "auth_wall": ["auth_required", "auth_wall_detected"],
    "captcha": ["bot_challenge_detected", "bot_wall_detected"], "redirect": ["geo_redirect_detected"],
}


def _any(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


def _body(text: Column) -> Column:
    return F.trim(F.lower(F.coalesce(text, F.lit(""))))


def _path(url: Column) -> Column:
    return F.lower(part(F.coalesce(url, F.lit("")), 3))


def _served(status: Column) -> Column:
    """A status of success or redirection, or none."""
    s = F.coalesce(status, F.lit(0))
    return (s == 0) | ((s >= 200) & (s < 400))


def is_login_wall(url: Column, text: Column) -> Column:
    """An address of a login with one phrase or hint of it, or any address with three phrases. Nulls count as empty."""
    body = _body(text)
    strong = F.size(F.filter(F.array(*[F.lit(p) for p in LOGIN_PHRASES]), lambda p: F.contains(body, p)))
    asked = (strong > 0) | _any(body, LOGIN_HINTS)
    return F.when(_any(_path(url), LOGIN_PATHS), asked).otherwise(strong >= 3)


def is_proof_wall(url: Column, status: Column, text: Column) -> Column:
    """A served page of at most PROOF_CHARS characters that asks for proof of a human; longer ones only speak of it."""
    body = _body(text)
    short = (body != "") & (F.length(body) <= PROOF_CHARS)
    return _served(status) & short & (_any(_path(url), PROOF_PATHS) | _any(body, PROOF_PHRASES))


def is_soft_failure(status: Column, content_type: Column, text: Column) -> Column:
    """A served page, no PDF, of at most FAILURE_CHARS characters that reports a failure."""
    body = _body(text)
    paper = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))
    return _served(status) & ~paper & (body != "") & (F.length(body) <= FAILURE_CHARS) & _any(body, FAILURE_PHRASES)


def asks_country(text: Column) -> Column:
    return _any(_body(text), COUNTRY_PHRASES)


def kind_of_error(error: Column) -> Column:
    """The kind of page that a final error implies; '' where it implies none."""
    e = F.lower(F.coalesce(error, F.lit("")))
    starts = {kind: F.exists(F.array(*[F.lit(p) for p in begins]), lambda p: F.startswith(e, p)) for kind, begins in ERROR_KINDS.items()}
    starts["auth_wall"] = starts["auth_wall"] | (F.startswith(e, F.lit("not_a_pdf")) & F.contains(e, F.lit("auth")))
    return F.coalesce(*[F.when(starts[kind], kind) for kind in ERROR_KINDS], F.lit(""))
