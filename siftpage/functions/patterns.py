"""Markers of walls, shells and empty results, as the page gate must know them."""

LENGTH_FLOOR, BLANK, THIN_BROWSER = 500, 32, 1024
JS_HEAVY = ["x.com", "twitter.com", "instagram.com", "tiktok.com", "trendyol.com", "aliexpress.com"]

# Fixed values, RE2 and Java both read them.
TURNSTILE = r"(?i)cf-turnstile|turnstile-callback|challenges\.cloudflare\.com/turnstile"
AKAMAI = r"(?i)_abck=|bm_sz=|akam/\d+/[0-9a-f]{6,}"
ANUBIS = r"(?i)anubis"
REDDIT = r"(?i)whoa there,? pardner|blocked due to a network policy|You must be 18\+ to view this community|attempting to access a blocked page"
BAXIA = r"(?i)_____tmd_____|x5secdata|x5step|slidecaptcha|nocaptcha|nc_iconfont|\bbaxia\b|slide to verify|Captcha Interception|Пройдите проверку"
CAPTCHA = r"(?is)Our systems have detected unusual traffic|/sorry/index|We're sorry\.\.\.|Bing/Block/CaptchaChallenge|<title>Bing</title>.{0,400}captcha|/fd/ls/lsp\.aspx"
VHOST = r"(?i)Welcome to nginx!|If you see this page, the nginx web server is successfully installed|Apache2 (Ubuntu )?Default Page|<title>\s*Apache Tomcat.{0,20}\s*</title>|This is the default (welcome )?page for this (web ?server|site)|IIS Windows Server"
CF = r"(?i)\bcf-chl-bypass\b|\bJust a moment\b"
BLOCK = r"\bcf-chl-bypass\b|_Incapsula_|\bpx-captcha\b|(?i:\bJust a moment\b|\bAttention Required\b|\bEnable JavaScript and cookies to continue\b|\bAccess denied\b|\bAre you a robot\b|\bYou've been blocked\b|\bnetwork security\b|whoa there,? pardner|attempting to access a blocked page|pardon the interruption|Request unsuccessful\.\s*Incapsula|checking your browser)"
SCRIPT = r"(?i)<script\b"
SHELL = r"""(?i)id="__next"|id="root"|id="app"|id="react-root"|window\.__data__|window\.__INITIAL_STATE__|<noscript|name="js_challenge"|name="jsc_orig_r"|<[a-z][a-z0-9]*-[a-z][a-z0-9-]*"""
CODE_BLOCK = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
LD_JSON = r"""(?i)type\s*=\s*["']application/ld\+json"""
SPA_MOUNT = r"""(?i)id="__next"|id="__nuxt"|id="root"|id="app"|id="react-root"|data-reactroot|__NEXT_DATA__|__NUXT_DATA__|window\.__INITIAL_STATE__|window\.__APOLLO_STATE__"""
EMPTY = r"(?is)\bno results?\b|\bno matches?\b|\b0 results?\b|\bno products?\s+(found|matched|available)\b|\bnothing found\b|\bdid not match any\b|\byour search\b.{0,60}\b(returned no|found no|did not|matched no)\b|bulunamadı"

# How much a verdict weighs against others.
VERDICT_RANK = {"paid_auth_error": 14, "dns_error": 13, "not_found": 12, "paywall": 11, "block_page_detected": 10, "anti_bot": 9, "blank_page": 8, "rate_limited": 7, "content_type_mismatch": 6, "proxy_unavailable": 5, "connection_error": 4, "timeout": 3, "length_floor": 2, "other": 1, "ok": 0}
