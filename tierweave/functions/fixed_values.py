"""Lists, tables and patterns that results depend on, in one place."""

# --- Fixed values: record types. (variant, hierarchy, label, category, evidence priority, description) ---
RECORD_TYPES = (
    ("DnsTxtSpf", "DNS::TXT::SPF", "Email Provider (SPF)", "Email & Authentication", 6, "Email sending authorization record"),
    ("DnsTxtVerification", "DNS::TXT::VERIFICATION", "Domain Verification", "Email & Authentication", 8, "Domain ownership verification record"),
    ("DnsTxtDmarc", "DNS::TXT::DMARC", "Email Security (DMARC)", "Email & Authentication", 5, "Email authentication policy record"),
    ("DnsTxtDkim", "DNS::TXT::DKIM", "Email Security (DKIM)", "Email & Authentication", 5, "Email signature verification record"),
    ("DnsSubdomain", "DNS::SUBDOMAIN", "Subdomains", "DNS Infrastructure", 2, "Subdomain delegation"),
    ("DnsMx", "DNS::MX", "Mail Server (MX)", "DNS Infrastructure", 2, "Mail exchange record"),
    ("DnsA", "DNS::A", "IPv4 Address (A)", "DNS Infrastructure", 2, "IPv4 address record"),
    ("DnsAaaa", "DNS::AAAA", "IPv6 Address (AAAA)", "DNS Infrastructure", 2, "IPv6 address record"),
    ("HttpWellKnown", "HTTP::WELL_KNOWN", "Well-Known URI", "HTTP Verification", 2, "HTTP well-known URI verification"),
    ("HttpMeta", "HTTP::META", "HTML Meta Tag", "HTTP Verification", 2, "HTML meta tag verification"),
    ("HttpFile", "HTTP::FILE", "Hosted File", "HTTP Verification", 2, "HTTP file-based verification"),
    ("CertDomain", "CERT::DOMAIN", "TLS Certificate", "Certificate Authority", 2, "SSL certificate domain verification"),
    ("CertSan", "CERT::SAN", "Certificate SAN", "Certificate Authority", 2, "SSL certificate subject alternative name"),
    ("ApiEndpoint", "API::ENDPOINT", "API Endpoint", "API Integration", 2, "API endpoint discovery"),
    ("ApiWebhook", "API::WEBHOOK", "API Webhook", "API Integration", 2, "Webhook endpoint registration"),
    ("HttpSubprocessor", "HTTP::SUBPROCESSOR", "Subprocessor Page", "HTTP Verification", 10, "HTTP subprocessor page listing"),
    ("SubfinderDiscovery", "DISCOVERY::SUBFINDER", "Subdomains", "Discovery", 4, "Subdomain discovered via subfinder"),
    ("SaasTenantProbe", "DISCOVERY::SAAS_TENANT", "SaaS Tenant", "Discovery", 7, "SaaS tenant probe discovery"),
    ("CtLogDiscovery", "DISCOVERY::CT_LOG", "Certificate Transparency Log", "Discovery", 3, "Certificate Transparency log discovery"),
    ("TrustCenterApi", "TRUST_CENTER::API", "Trust Center", "Trust Center", 9, "Trust center API extraction"),
    ("WebTrafficSource", "DISCOVERY::WEBPAGE_SOURCE", "Webpage Source", "Discovery", 4, "External resource referenced in webpage source"),
    ("WebTrafficNetwork", "DISCOVERY::WEBPAGE_NETWORK", "Webpage Network Requests", "Discovery", 5, "Runtime network request from webpage to external domain"),
    ("Unknown", "UNKNOWN", "Other", "Other", 0, "Unknown record type"),
)
LEGACY_TYPES = {"SPF": "DnsTxtSpf", "VERIFICATION": "DnsTxtVerification", "SUBDOMAIN": "DnsSubdomain"}

# --- Fixed values: domain lists. ---
COMMON_INFRASTRUCTURE = (
    "amazon.com", "amazonaws.com", "microsoft.com", "google.com", "googletagmanager.com", "googlehosted.com", "googlesyndication.com", "googleadservices.com", "googleusercontent.com", "googleapis.com",
    "cloudflare.com", "cloudflare-dns.com", "fastly.com", "akamai.com", "azure.com", "office365.com", "outlook.com", "googlemail.com", "gmail.com",
)
MARKETING = (
    "facebook.com", "facebook.net", "fbcdn.net", "fbsbx.com", "licdn.com", "ads-twitter.com", "analytics.twitter.com", "t.co", "tiktok.com", "tiktokcdn.com", "ttwstatic.com",
    "redditstatic.com", "redditmedia.com", "snapchat.com", "sc-static.net", "doubleclick.net",
)
SELF_ALIAS_GROUPS = (("klaviyo.com", "myklpages.com", "klaviyomail.com"), ("markmonitor.com", "saasbee.com"))
WEB_NOISE = ("localhost", "127.0.0.1", "0.0.0.0", "[::1]", "chromium.org", "gstatic.com", "googleapis.com", "w3.org", "schema.org", "ogp.me")
SOCIAL = (
    "facebook.com", "facebook.net", "linkedin.com", "twitter.com", "x.com", "youtube.com", "instagram.com", "tiktok.com", "pinterest.com", "reddit.com", "threads.net", "mastodon.social", "discord.com", "discord.gg",
)
CERTIFICATE_INFRASTRUCTURE = (
    "cloudflare.com", "cloudflare.net", "cloudfront.net", "akamai.com", "akamaiedge.net", "fastly.net", "fastly.com", "edgekey.net", "edgesuite.net", "amazonaws.com", "azure.com", "azurewebsites.net", "azureedge.net",
    "googleusercontent.com", "googlesyndication.com", "gstatic.com", "letsencrypt.org", "digicert.com", "comodo.com", "godaddy.com", "rapidssl.com", "geotrust.com", "thawte.com", "entrust.net", "sectigo.com",
    "localhost", "local", "test", "example.com",
)
TECHNICAL_PREFIXES = ("_spf.", "spf.", "_dmarc.", "dmarc.", "_domainkey.", "selector1._domainkey.", "selector2._domainkey.", "_smtp.", "smtp.", "mail.", "email.")

# --- Fixed values: TXT records. ---
SPF_MECHANISMS = (r"include:\s*([^\s]+)", r"redirect=\s*([^\s]+)", r"a:\s*([^\s]+)", r"mx:\s*([^\s]+)", r"exists:\s*([^\s]+)", r"ptr:\s*([^\s]+)")
SPF_MACRO = r"%\{[a-zA-Z]+[0-9]*[a-zA-Z]*\}\.?"
DMARC_MAILTO = r"mailto:([^@,\s]+@)?([^,;\s]+)"
DKIM_TAGS = (r"p=([A-Za-z0-9+/=]+)", r"h=([^;]+)", r"s=([^;]+)")
PROVIDER_TOKENS = (r"([a-zA-Z0-9]+)(?:-domain)?-verification=", r"verification-([a-zA-Z0-9]+)=", r"([a-zA-Z0-9]+)-site-verification=", r"([A-Z0-9]+)_verify_")
DNS_NAME = r"^[a-zA-Z0-9_][a-zA-Z0-9\-_]{0,62}(\.[a-zA-Z0-9_][a-zA-Z0-9\-_]{0,62})*$"
VERIFICATION_PATTERNS = (
    ("google-site-verification=", "google.com"), ("facebook-domain-verification=", "facebook.com"), ("MS=", "microsoft.com"), ("apple-domain-verification=", "apple.com"), ("adobe-idp-site-verification=", "adobe.com"),
    ("stripe-verification=", "stripe.com"), ("docusign=", "docusign.com"), ("globalsign-domain-verification=", "globalsign.com"), ("dropbox-domain-verification=", "dropbox.com"), ("ZOOM_verify_", "zoom.us"),
    ("atlassian-domain-verification=", "atlassian.com"), ("browserstack-domain-verification=", "browserstack.com"), ("canva-site-verification=", "canva.com"), ("cursor-domain-verification", "cursor.com"),
    ("datadome-domain-verify=", "datadome.co"), ("drift-domain-verification=", "drift.com"), ("hubspot-domain-verification=", "hubspot.com"), ("klaviyo-site-verification=", "klaviyo.com"), ("notion-domain-verification=", "notion.so"),
    ("onetrust-domain-verification=", "onetrust.com"), ("openai-domain-verification=", "openai.com"), ("postman-domain-verification=", "postman.com"), ("slack-domain-verification=", "slack.com"), ("teamviewer-sso-verification=", "teamviewer.com"),
    ("wework-site-verification=", "wework.com"), ("heroku-domain-verification=", "heroku.com"), ("jamf-site-verification=", "jamf.com"), ("anthropic-domain-verification", "anthropic.com"), ("jetbrains-domain-verification=", "jetbrains.com"),
    ("gc-ai-domain-verification", "gc-ai.com"), ("intacct-esk=", "sage.com"), ("mgverify=", "mailgun.com"), ("neat-pulse-domain-verification", "neat.co"), ("webex-domain-verification=", "webex.com"), ("zoom-domain-verification=", "zoom.us"),
    ("have-i-been-pwned-verification=", "haveibeenpwned.com"), ("<whimsical=", "whimsical.com"),
)
PROVIDERS = (
    ("google", "google.com"), ("microsoft", "microsoft.com"), ("apple", "apple.com"), ("adobe", "adobe.com"), ("stripe", "stripe.com"), ("docusign", "docusign.com"), ("globalsign", "globalsign.com"), ("dropbox", "dropbox.com"),
    ("zoom", "zoom.us"), ("atlassian", "atlassian.com"), ("browserstack", "browserstack.com"), ("canva", "canva.com"), ("cursor", "cursor.com"), ("datadome", "datadome.co"), ("drift", "drift.com"), ("hubspot", "hubspot.com"),
    ("klaviyo", "klaviyo.com"), ("notion", "notion.so"), ("onetrust", "onetrust.com"), ("openai", "openai.com"), ("postman", "postman.com"), ("slack", "slack.com"), ("teamviewer", "teamviewer.com"), ("wework", "wework.com"),
    ("heroku", "heroku.com"), ("jamf", "jamf.com"), ("intacct", "sage.com"), ("mailgun", "mailgun.com"), ("neat", "neat.co"), ("webex", "webex.com"), ("whimsical", "whimsical.com"), ("facebook", "facebook.com"),
    ("anthropic", "anthropic.com"), ("jetbrains", "jetbrains.com"), ("github", "github.com"), ("gitlab", "gitlab.com"), ("bitbucket", "bitbucket.org"), ("okta", "okta.com"), ("auth0", "auth0.com"), ("twilio", "twilio.com"),
    ("segment", "segment.com"), ("sentry", "sentry.io"), ("pagerduty", "pagerduty.com"), ("aws", "amazon.com"), ("gcp", "google.com"), ("azure", "microsoft.com"), ("salesforce", "salesforce.com"), ("shopify", "shopify.com"),
    ("zendesk", "zendesk.com"),
)
#: Providers whose domain is their name with ``.com``, tried last.
PROVIDERS_DOT_COM = ("sendgrid", "mailchimp", "constantcontact", "pardot", "marketo", "hubspot", "intercom", "freshdesk", "typeform")

# --- Fixed values: organization names. ---
CORPORATE_SUFFIXES = (
    "corporation", "incorporated", "limited liability company", "limited partnership", "public limited company", "gesellschaft mit beschrankter haftung", "sociedad de responsabilidad limitada", "societa a responsabilita limitata",
    "besloten vennootschap", "naamloze vennootschap", "aktiengesellschaft", "societe anonyme", "proprietary limited", "private limited", "public benefit corporation", "pty ltd", "pvt ltd", "limited", "company", "inc", "llc", "ltd", "gmbh",
    "corp", "co", "plc", "ag", "sa", "sas", "srl", "bv", "nv", "pbc", "pty", "pvt", "lp", "l.p", "llp", "l.l.p", "s.r.l", "s.a.s", "s.a", "s.p.a", "l.l.c",
)
ACRONYMS = ("IBM", "AWS", "GCP", "USA", "UK", "EU", "AI", "HR", "PR", "QA", "HP", "SAP", "AMD", "SAS", "EMC", "NCR")
SMALL_WORDS = ("of", "and", "the", "in", "for", "on", "at", "to", "by", "or", "an", "a")
PHRASE_MARKERS = (" for ", " that ", " your ", " helps ", " enables ", " enabling ", " powering ", " powered by ", " building ", " simplify ", " automate ", " designed ")

# --- Fixed values: names that belong to go-betweens, whole ones and phrases, with their roles. ---
EXACT_GO_BETWEENS = (
    ("private", "privacy"), ("privado", "privacy"), ("redacted", "privacy"), ("withheld", "privacy"), ("not disclosed", "privacy"), ("not applicable", "privacy"), ("n/a", "privacy"), ("na", "privacy"), ("none", "privacy"),
    ("null", "privacy"), ("unknown", "privacy"), ("-", "privacy"), ("switch", "registry"), ("donuts", "registrar"), ("hover", "registrar"), ("epik", "registrar"), ("registry operator", "registry"),
)
PHRASE_GO_BETWEENS = (
    ("domains by proxy", "privacy"), ("dnstination", "privacy"), ("domain protection services", "privacy"), ("privacyguardian", "privacy"), ("registration private", "privacy"), ("privacy id", "privacy"),
    ("whois agent", "privacy"), ("whoisproxy", "privacy"), ("domain admin", "privacy"), ("domain administrator", "privacy"), ("aruba pec", "registrar"), ("wild west domains", "registrar"), ("whoisguard", "privacy"),
    ("whois privacy", "privacy"), ("privacy protect", "privacy"), ("privacy protection", "privacy"), ("privacy service", "privacy"), ("perfect privacy", "privacy"), ("contact privacy", "privacy"),
    ("redacted for privacy", "privacy"), ("withheld for privacy", "privacy"), ("identity protection service", "privacy"), ("identity protect", "privacy"), ("data protected", "privacy"), ("statutory masking", "privacy"),
    ("gdpr masked", "privacy"), ("privacydotlink", "privacy"), ("super privacy service", "privacy"), ("markmonitor", "registrar"), ("csc corporate domains", "registrar"), ("corporatedomains", "registrar"),
    ("safenames", "registrar"), ("com laude", "registrar"), ("nameprotect", "registrar"), ("brand protection", "registrar"), ("domain management", "registrar"), ("network solutions", "registrar"),
    ("networksolutions", "registrar"), ("godaddy", "registrar"), ("namecheap", "registrar"), ("namesilo", "registrar"), ("enom", "registrar"), ("tucows", "registrar"), ("opensrs", "registrar"), ("key-systems", "registrar"),
    ("gandi", "registrar"), ("porkbun", "registrar"), ("dynadot", "registrar"), ("register.com", "registrar"), ("name.com", "registrar"), ("domain.com", "registrar"), ("amazon registrar", "registrar"),
    ("google domains", "registrar"), ("squarespace domains", "registrar"), ("cloudflare registrar", "registrar"), ("bluehost", "registrar"), ("hostgator", "registrar"), ("dreamhost", "registrar"), ("siteground", "registrar"),
    ("hostinger", "registrar"), ("publicdomainregistry", "registrar"), ("pdr ltd", "registrar"), ("sav.com", "registrar"), ("reg.ru", "registrar"), ("ascio", "registrar"), ("onlinenic", "registrar"), ("todaynic", "registrar"),
    ("xin net", "registrar"), ("west263", "registrar"), ("alibaba cloud computing", "registrar"), ("gmo internet", "registrar"), ("verisign", "registry"), ("public interest registry", "registry"), ("afilias", "registry"),
    ("identity digital", "registry"), ("centralnic", "registry"), ("nominet", "registry"), ("denic", "registry"), ("afnic", "registry"), ("icann", "registry"), ("registro.br", "registry"), ("registro.it", "registry"),
    ("global registry services", "registry"), ("domain name commission", "registry"), ("domain administration", "registry"), ("national internet exchange", "registry"), ("rotld", "registry"), ("nic.ro", "registry"),
    ("nic.at", "registry"), ("nic.br", "registry"), ("eurid", "registry"), ("dns belgium", "registry"), ("dk hostmaster", "registry"), ("punktum dk", "registry"), ("internet stiftelsen", "registry"), ("norid", "registry"),
    ("cnnic", "registry"), ("krnic", "registry"), ("jprs", "registry"), ("sgnic", "registry"), ("twnic", "registry"), ("hkirc", "registry"), ("mynic", "registry"), ("thnic", "registry"), ("vnnic", "registry"),
    ("sidn", "registry"), ("nic.ch", "registry"), ("nic.cz", "registry"), ("nic.pl", "registry"), ("nic.ir", "registry"), ("nic.at", "registry"), ("dns.pt", "registry"), ("registry.in", "registry"), ("nixi", "registry"),
    ("national internet exchange of india", "registry"), ("auda", "registry"), (".au domain administration", "registry"), ("nz domain name commission", "registry"), ("cira", "registry"), ("domaininfo.com", "registry"),
    ("government of anguilla", "registry"), ("internet computer bureau", "registry"), ("ministry of information and communications technologies", "registry"), ("mintic", "registry"), ("charleston road registry", "registry"),
    ("binky moon", "registry"), ("dog beach", "registry"), ("radix technologies", "registry"), ("radix fzc", "registry"), ("neustar", "registry"), ("registry", "registry"), ("ionos", "registrar"), ("1&1 internet", "registrar"),
    ("corporatedomains.com", "registrar"), ("cloudflare", "registrar"), ("registrant street", "address"), ("registrant city", "address"), ("registrant state", "address"), ("registrant postal", "address"),
    ("registrant country", "address"), ("registrant phone", "address"), ("registrant email", "address"), ("registrant fax", "address"), ("admin street", "address"), ("admin city", "address"),
    ("tech street", "address"), ("tech city", "address"), ("po box", "address"), ("p.o. box", "address"), ("care of", "address"),
)
REDACTIONS = ("on behalf of", "data redacted", "data protected", "redacted for", "not disclosed", "non-public data", "gdpr", "statutory masking", "domain owner", "registrant of", "owner of ")
STATE_AUTHORITIES = (
    "government of", "ministry of", "agence nationale", "consulate of", "embassy of", "telecommunications regulatory", "communications authority", "posts and telecommunications", "post and telecommunications",
)
GOVERNMENT_LABELS = ("gov", "gouv", "gob", "go", "mil", "gc")
LEGAL_WORDS = ("inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "plc", "ag", "sa", "bv", "nv", "s.a", "s.r.l", "pty", "pvt", "lp", "llp")
GENERIC_WORDS = (
    "domain", "domains", "privacy", "proxy", "network", "networks", "registry", "registrar", "protection", "service", "services", "hosting", "host", "internet", "web", "online", "digital", "identity", "global", "cloud", "solutions",
)
INFERRED_SUFFIXES = ("", " inc", " inc.", " llc", " ltd", " ltd.", " corp", " corp.", " corporation", " company")

# --- Fixed values: web pages. Resource patterns in their order, names that name nobody, copyright notices, marks of frameworks, types of organizations. ---
RESOURCES = (
    ("script src", r"""<script[^>]+src\s*=\s*["']([^"']+)["']"""), ("link href", r"""<link[^>]+href\s*=\s*["']([^"']+)["']"""), ("img src", r"""<img[^>]+src\s*=\s*["']([^"']+)["']"""),
    ("iframe src", r"""<iframe[^>]+src\s*=\s*["']([^"']+)["']"""), ("data-src", r"""data-(?:src|href)\s*=\s*["'](https?://[^"']+)["']"""),
    ("inline URL", r"""["'](https?://[a-zA-Z0-9][-a-zA-Z0-9.]*\.[a-zA-Z]{2,}[^"']*?)["']"""),
)
NO_NAMES = (
    "home", "welcome", "about", "contact", "login", "sign in", "sign up", "register", "dashboard", "admin", "404", "error", "page not found", "undefined", "null", "none", "n/a", "test", "example", "loading", "loading...", "please wait", "redirecting",
)
PAGE_NAMES = (
    "Home", "Welcome", "About", "Contact", "Login", "Sign", "Register", "Dashboard", "Settings", "Profile", "Account", "Blog", "News", "Products", "Services", "Pricing", "Support", "Help", "FAQ", "Privacy", "Terms", "Legal", "Careers", "Jobs",
)
COPYRIGHT = (
    r"(?i)(?:©|&copy;|\(c\))\s*(?:20\d{2}[-–]?\s*)?(?:20\d{2}\s+)?([A-Z][A-Za-z0-9\s,&']+?(?:\s*(?:Inc\.?|LLC|Ltd\.?|Corp\.?|Corporation|Company|Co\.?|GmbH|Pty|Limited))?)(?:\s*\.|\s*,|\s+All\s+[Rr]ights)",
    r"(?i)Copyright\s+(?:©|&copy;)?\s*(?:20\d{2}[-–]?\s*)?(?:20\d{2}\s+)?([A-Z][A-Za-z0-9\s,&']+?(?:\s*(?:Inc\.?|LLC|Ltd\.?|Corp\.?|Corporation|Company|Co\.?|GmbH|Pty|Limited))?)(?:\s*\.|\s*,|\s+All\s+[Rr]ights)",
    r"(?i)(?:©|&copy;|\(c\)|copyright)\s*20\d{2}\s+([A-Z][A-Za-z0-9\s]+?)(?:\.|\s+All)",
)
SPA_MARKERS = ("__next_data__", "__nuxt__", 'id="root"', 'id="app"', "data-reactroot", "ng-version", "window.__initial_state__")
ORG_TYPES = ("Organization", "Corporation", "LocalBusiness", "Company", "Brand", "NGO", "GovernmentOrganization", "EducationalOrganization")

# --- Fixed values: registration records and attribution. Texts that are no names, pages that say nothing, owners of brand suffixes, corrected rollups, spellings of brands. ---
PLACEHOLDERS = (
    "whois privacy protection service", "privacy protection service", "domains by proxy", "whoisguard", "perfect privacy", "redacted for privacy", "contact privacy inc", "n/a", "not disclosed", "private", "redacted", "withheld",
    "verisign global registry", "verisign", "vrsn", "pir.org", "public interest registry", "afilias", "donuts", "identity digital", "centralnic", "nic.br", "denic", "nominet", "afnic", "sidn", "registry operator",
    "global registry services", "icann", "nic.ro", "rotld", "registro.br", "cnnic", "jprs", "krnic", "twnic", "mynic", "thnic", "vnnic", "sgnic", "hkirc", "auda", ".au domain administration", "nz domain name commission", "cira",
    "nic.at", "nic.ch", "switch", "dns belgium", "dns.pt", "nic.cz", "nic.pl", "domaininfo.com", "registro.it", "nic.ir", "registry.in", "nixi", "national internet exchange of india", "markmonitor", "csc corporate domains",
    "corporatedomains.com", "safenames", "com laude", "nameprotect", "brand protection", "domain management", "networksolutions", "network solutions", "godaddy", "namecheap", "enom", "tucows", "key-systems", "gandi",
    "identity protection service", "identity protect", "amazon registrar", "amazon registrar, inc.", "porkbun", "cloudflare", "dynadot", "hover", "google domains", "squarespace domains", "bluehost", "hostgator", "dreamhost",
    "siteground", "ionos", "register.com", "name.com", "domain.com", "epik", "registrant street", "registrant city", "registrant state", "registrant postal", "registrant country", "registrant phone", "registrant email",
    "registrant fax", "admin street", "admin city", "tech street", "tech city", "po box", "p.o. box", "care of", "c/o ",
)
INTERSTITIALS = (
    "attention required", "just a moment", "checking your browser", "verify you are human", "are you a robot", "security check", "access denied", "403 forbidden", "page not found", "404 not found", "domain for sale",
    "buy this domain", "this domain is for sale", "under construction", "coming soon", "index of /", "example domain", "please visit", "webbased whois", "web-based whois", "whois server", "not shown", "see the whois",
    "query the whois", "for more information",
)
BRAND_SUFFIXES = (
    ("google", "Google"), ("gle", "Google"), ("youtube", "Google"), ("android", "Google"), ("chrome", "Google"), ("gmail", "Google"), ("aws", "Amazon"), ("amazon", "Amazon"), ("microsoft", "Microsoft"), ("azure", "Microsoft"),
    ("xbox", "Microsoft"), ("bing", "Microsoft"), ("apple", "Apple"), ("icloud", "Apple"), ("meta", "Meta"), ("facebook", "Meta"), ("instagram", "Meta"), ("whatsapp", "Meta"), ("oracle", "Oracle"), ("java", "Oracle"),
    ("ibm", "IBM"), ("cisco", "Cisco"), ("intel", "Intel"), ("dell", "Dell"), ("hp", "HP"), ("sap", "SAP"), ("salesforce", "Salesforce"), ("adobe", "Adobe"), ("netflix", "Netflix"), ("linkedin", "LinkedIn"), ("paypal", "PayPal"),
    ("visa", "Visa"), ("mastercard", "Mastercard"), ("walmart", "Walmart"), ("target", "Target"), ("nike", "Nike"), ("bmw", "BMW"), ("audi", "Audi"), ("ford", "Ford"), ("toyota", "Toyota"),
)
STALE_ROLLUPS = (
    ("paypal.com", "PayPal"), ("github.com", "GitHub"), ("linkedin.com", "LinkedIn"),
)
BRAND_CASING = (
    ("openai", "OpenAI"), ("anthropic", "Anthropic"), ("anthropicai", "Anthropic"), ("mongodb", "MongoDB"), ("hubspot", "HubSpot"), ("docusign", "DocuSign"), ("github", "GitHub"), ("gitlab", "GitLab"), ("paypal", "PayPal"),
    ("youtube", "YouTube"), ("linkedin", "LinkedIn"), ("mysql", "MySQL"), ("postgresql", "PostgreSQL"), ("postgres", "PostgreSQL"), ("graphql", "GraphQL"), ("nodejs", "Node.js"), ("node.js", "Node.js"),
    ("typescript", "TypeScript"), ("javascript", "JavaScript"), ("pagerduty", "PagerDuty"), ("godaddy", "GoDaddy"), ("woocommerce", "WooCommerce"), ("wordpress", "WordPress"), ("ebay", "eBay"), ("icloud", "iCloud"),
    ("doordash", "DoorDash"), ("surveymonkey", "SurveyMonkey"), ("sendgrid", "SendGrid"), ("mailchimp", "Mailchimp"), ("auth0", "Auth0"), ("onetrust", "OneTrust"), ("servicenow", "ServiceNow"), ("vmware", "VMware"),
    ("netsuite", "NetSuite"), ("quickbooks", "QuickBooks"), ("zoominfo", "ZoomInfo"), ("semrush", "SEMrush"), ("launchdarkly", "LaunchDarkly"), ("logrocket", "LogRocket"), ("fullstory", "FullStory"),
    ("browserstack", "BrowserStack"), ("digitalocean", "DigitalOcean"), ("jetbrains", "JetBrains"), ("bigquery", "BigQuery"), ("dynamodb", "DynamoDB"), ("cockroachdb", "CockroachDB"), ("clickhouse", "ClickHouse"),
    ("planetscale", "PlanetScale"), ("supabase", "Supabase"), ("netapp", "NetApp"), ("workos", "WorkOS"), ("typeform", "Typeform"), ("notioniq", "Notion"), ("e2b", "E2B"), ("cloudamqp", "CloudAMQP"), ("keycdn", "KeyCDN"),
    ("maxcdn", "MaxCDN"), ("jsdelivr", "jsDelivr"), ("npm", "npm"), ("pypi", "PyPI"), ("webrtc", "WebRTC"), ("openssl", "OpenSSL"), ("letsencrypt", "Let's Encrypt"), ("let's encrypt", "Let's Encrypt"), ("hashicorp", "HashiCorp"),
    ("influxdb", "InfluxDB"), ("elasticsearch", "Elasticsearch"), ("opensearch", "OpenSearch"), ("getsentry", "Sentry"), ("sentry", "Sentry"), ("statuspage", "Statuspage"), ("squarespace", "Squarespace"),
    ("sharepoint", "SharePoint"), ("onedrive", "OneDrive"), ("outsystems", "OutSystems"), ("coinbase", "Coinbase"), ("youtubetv", "YouTube TV"),
)
ORG_ALIASES = (
    ("msft", "Microsoft"), ("goog", "Google"), ("googl", "Google"), ("amzn", "Amazon"), ("aapl", "Apple"), ("nflx", "Netflix"), ("ibm", "IBM"), ("orcl", "Oracle"), ("tsla", "Tesla"), ("nvda", "NVIDIA"), ("intc", "Intel"),
    ("csco", "Cisco"), ("adbe", "Adobe"), ("aws", "Amazon Web Services"), ("gcp", "Google Cloud Platform"), ("azure", "Microsoft Azure"), ("hpe", "Hewlett Packard Enterprise"), ("dell emc", "Dell Technologies"),
    ("vmware", "VMware"), ("google llc", "Google"), ("google inc", "Google"), ("google inc.", "Google"), ("alphabet", "Google"), ("alphabet inc", "Google"), ("microsoft corporation", "Microsoft"), ("microsoft corp", "Microsoft"),
    ("microsoft corp.", "Microsoft"), ("amazon.com", "Amazon"), ("amazon.com inc", "Amazon"), ("amazon.com, inc.", "Amazon"), ("apple inc", "Apple"), ("apple inc.", "Apple"), ("apple computer", "Apple"),
    ("facebook", "Meta Platforms"), ("facebook inc", "Meta Platforms"), ("facebook, inc.", "Meta Platforms"), ("meta platforms, inc.", "Meta Platforms"), ("amazon web services, inc.", "Amazon Web Services"),
    ("amazon web services inc", "Amazon Web Services"), ("google cloud", "Google Cloud Platform"), ("microsoft azure", "Microsoft Azure"), ("mircosoft", "Microsoft"), ("miscrosoft", "Microsoft"), ("goole", "Google"),
    ("amozon", "Amazon"),
)

# --- Fixed values: tenants. Moves of a whole site to another domain. ---
KNOWN_REDIRECTS = (("duosecurity.com", "duo.com"),)

# --- Fixed values: subprocessor pages. Where they stand, words that are no vendors, names that are no organizations. ---
SUBPROCESSOR_PATHS = (
    "/legal/subprocessors", "/subprocessors", "/legal/service-providers", "/sub-processors", "/legal/sub-processors", "/privacy/subprocessors", "/trust/subprocessors", "/security/subprocessors", "/gdpr/subprocessors", "/vendors",
)
SUBPROCESSOR_SECTIONS = ("", "/legal", "/privacy", "/trust", "/security", "/gdpr", "/compliance")
SUBPROCESSOR_PAGES = ("subprocessors", "sub-processors", "subprocessor-list", "service-providers", "third-parties", "vendors")
TRUST_LABELS = ("trust", "security", "privacy", "legal", "compliance")
PLACEHOLDER_LABELS = ("example", "test", "domain", "yourdomain", "yoursite", "mysite", "website", "company", "yourcompany", "placeholder", "sample", "localhost", "none", "null", "na", "n/a", "unknown")
VENDOR_WORDS = (
    "inc", "llc", "ltd", "corp", "corporation", "gmbh", "company", "technologies", "services", "service", "provides", "provider", "hosting", "hosts", "platform", "analytics", "cloud", "payment", "processing", "processor", "email", "infrastructure", "storage",
)
COMMON_WORDS = (
    "conditions", "prevention", "logging", "support", "services", "compliance", "security", "privacy", "access", "control", "information", "processing", "hosting", "storage", "analytics", "monitoring", "infrastructure", "management", "customer",
    "customers", "data", "email", "service", "provider", "providers", "vendor", "vendors", "subprocessor", "subprocessors", "purpose", "location", "country", "region", "name", "address", "contact", "terms", "policy", "policies", "legal",
    "website", "platform", "software", "product", "products", "payment", "payments", "billing", "delivery", "content", "communication", "communications", "development", "engineering", "marketing", "sales", "operations", "authentication",
    "encryption", "detection", "response", "backup", "recovery", "america", "europe", "asia", "africa", "australia", "romania", "brazil", "india", "japan", "france", "germany", "ireland", "spain", "italy", "canada", "mexico", "china",
    "singapore", "netherlands", "sweden", "poland", "portugal", "switzerland", "austria", "belgium", "denmark", "finland", "norway", "israel",
)
LANGUAGE_CODES = ("ar", "cs", "da", "de", "el", "en", "es", "fi", "fr", "he", "hi", "hu", "id", "it", "ja", "ko", "ms", "nb", "nl", "no", "pl", "pt", "ro", "ru", "sv", "th", "tr", "uk", "vi", "zh")
STANDARDS = (
    "iso", "iec", "soc", "soc 2", "soc2", "pci-dss", "pci dss", "gdpr", "hipaa", "nist", "fedramp", "ccpa", "cpra", "ferpa", "owasp", "aicpa", "ssae", "csa star", "cis", "cobit", "itil", "cmmc", "fisma",
)
NON_VENDORS = (
    "salvation army", "red cross", "united nations", "world health organization", "federal trade commission", "ftc", "department of defense", "dod", "european commission", "ieee", "ietf", "w3c", "international organization for standardization",
    "national institute of standards and technology",
)
ROW_MARKERS = (
    "united states", "united kingdom", "european union", "third party subprocessors", "name of subprocessor", "description of processing", "location of processing", "processing location", "corporate location",
)

# --- Fixed values: trust centers. Patterns of data that pages embed, with the least length of what they hold. ---
#: Public address of a vendor report, before its slug.
REPORT_ADDRESS = "https://api.conveyor.com/public/public_vendor_reports/by_slug?slug="
NEXT_DATA = r"""(?s)<script\s+id="__NEXT_DATA__"[^>]*>(.*?)</script>"""
JSON_SCRIPT = r"""(?is)<script[^>]*type="application/json"[^>]*>(.*?)</script>"""
BASE64_BLOBS = (r'''data-[a-z-]+="([A-Za-z0-9+/=]{200,})"''', r'''atob\s*\(\s*["']([A-Za-z0-9+/=]{200,})["']\s*\)''', r'''(?:var|let|const)\s+\w+\s*=\s*["']([A-Za-z0-9+/=]{200,})["']''')
JS_OBJECTS = r"window\.([A-Z_][A-Z_0-9]*)\s*=\s*(\{[\s\S]{200,}?\})(?:\s*;|\s*<)"
NO_SLUGS = ("api", "graphql", "trust", "security", "legal", "privacy", "subprocessors")
SHARED_ORG_KEYS = ("unknown", "n/a", "none", "private", "redacted", "redacted for privacy")

# --- Fixed values: short labels of record types, and of the phases that find them. Compound suffixes of the known-vendor lookup. Kinds of entities that are organizations. ---
SHORT_LABELS = (
    ("DnsTxtSpf", "SPF"), ("DnsTxtVerification", "DNS Verification"), ("DnsTxtDmarc", "DMARC"), ("DnsTxtDkim", "DKIM"), ("DnsSubdomain", "Subdomain"), ("DnsMx", "MX"), ("DnsA", "A Record"), ("DnsAaaa", "AAAA Record"), ("HttpWellKnown", "Well-Known"),
    ("HttpMeta", "Meta Tag"), ("HttpFile", "Hosted File"), ("CertDomain", "TLS Cert"), ("CertSan", "Cert SAN"), ("ApiEndpoint", "API Endpoint"), ("ApiWebhook", "API Webhook"), ("HttpSubprocessor", "Subprocessor"), ("SubfinderDiscovery", "Subdomain"),
    ("SaasTenantProbe", "SaaS Tenant"), ("CtLogDiscovery", "CT Log"), ("TrustCenterApi", "Trust Center"), ("WebTrafficSource", "Webpage Source"), ("WebTrafficNetwork", "Webpage Network"), ("Unknown", "Other"),
)
PHASE_LABELS = (
    ("HTTP::SUBPROCESSOR", "subprocessor"), ("DNS::TXT::SPF", "SPF"), ("DNS::TXT::VERIFICATION", "DNS verification"), ("DNS::TXT::DMARC", "DMARC"), ("DISCOVERY::SUBFINDER", "subfinder"), ("DISCOVERY::SAAS_TENANT", "SaaS tenant"), ("DISCOVERY::CT_LOG", "CT log"),
)
LOOKUP_SUFFIXES = ("co.uk", "co.au", "com.au", "co.nz", "co.jp", "co.kr", "com.br", "com.mx", "com.cn", "org.uk", "net.au")
ORG_ENTITIES = ("organization", "company", "product", "brand")
