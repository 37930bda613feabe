"""The shipped rule catalog as data.

Fixed values: patterns, lexicons, stop lists and constants that results depend on are stated here as text.
"""

from __future__ import annotations

#: Name, severity (1 is worst), description, regular expression, scope.
REGEXP_RULES: list[tuple[str, int, str, str, str]] = [
    ("email", 4, "E-mail address", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "token"),
    ("vsnr", 2, "Pension insurance number, compact", r"\b\d{2}\d{6}[A-Za-z]\d{2}\d\b", "token"),
    ("vsnr_formatiert", 2, "Pension insurance number, spaced", r"\b\d{2} \d{6} ?[A-Za-z] ?\d{2} ?\d\b", "line"),
    ("strasse", 4, "Street name by suffix", r"(?i)\b\w*(strasse|straße|street)\b|\b\w{3,}(weg|allee|platz|gasse|damm|ufer)\b", "token"),
    ("JWT", 1, "JSON web token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "token"),
    ("SSHPrivateKey", 1, "SSH private key", r"-----BEGIN\s+(RSA\s+|EC\s+|OPENSSH\s+)?PRIVATE\s+KEY-----", "line"),
    ("TLSPrivateKey", 1, "TLS private key", r"-----BEGIN\s+(ENCRYPTED\s+)?PRIVATE\s+KEY-----", "line"),
    ("Kreditkarte", 1, "Payment card number", r"(?i)\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "line"),
    ("IBAN", 2, "Bank account number", r"(?i)\b[A-Z]{2}\d{2}[\s]?[A-Z0-9]{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{0,4}\b", "line"),
    ("SteuerID", 3, "German tax number", r"\b\d{11}\b", "token"),
    ("Telefon", 4, "German telephone number", r"(?<![\d/-])(\+\d[\d\s/-]{8,20}\d|0\d[\d\s/-]{7,20}\d)(?![\d/-])", "line"),
    ("PLZ", 4, "German postal code", r"\b\d{5}\b", "token"),
    ("JDBC", 3, "JDBC connection string", r"(?i)jdbc:[a-z]+://[^\s]+", "line"),
    ("PersonalausweisNr", 4, "German identity card number", r"\b[CFGHJKLMNPRTVWXYZ][0-9A-Z]{8}\d\b", "token"),
    ("KVNR", 2, "German health insurance number", r"\b[A-Z]\d{9}\b", "token"),
    ("IPAdresse", 4, "IPv4 address", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "token"),
    ("InterneIP", 3, "Private IPv4 address", r"\b(?:10\.(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){2}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)|172\.(?:1[6-9]|2\d|3[01])\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)|192\.168\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?))\b(?!\.\d)", "token"),
    ("MACAdresse", 4, "MAC address", r"(?i)\b(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}\b", "token"),
    ("IMEI", 4, "Device number", r"\b\d{15}\b", "token"),
    ("Kennzeichen", 4, "German licence plate", r"\b[A-ZÄÖÜ]{1,3}-[A-Z]{1,2} ?\d{1,4}[EH]?\b", "line"),
    ("BIC", 3, "Bank identifier", r"\b[A-Z]{4}(DE|AT|CH|FR|GB|NL|BE|LU|IT|ES|PL|CZ|DK|SE|NO|FI|US)[A-Z0-9]{2}([A-Z0-9]{3})?\b", "token"),
    ("UStIdNr", 3, "German VAT number", r"\bDE\d{9}\b", "token"),
    ("HRNummer", 3, "German trade register number", r"\bHR[AB] ?\d{3,8}\b", "line"),
    ("KindergeldNr", 3, "Child benefit number", r"\bFK\d{6}\b", "token"),
    ("AWSAccessKey", 1, "AWS access key id", r"\bAKIA[0-9A-Z]{16}\b", "token"),
    ("AzureAccountKey", 1, "Azure storage key", r"(?i)AccountKey=[A-Za-z0-9+/=]{40,}", "line"),
    ("GitHubToken", 1, "GitHub token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b", "token"),
    ("SlackToken", 1, "Slack token", r"\bxox[bpors]-[A-Za-z0-9-]{10,}\b", "token"),
    ("Lizenzschluessel", 2, "Licence key", r"(?<![A-Za-z0-9-])(?=[0-9-]*[A-Z])[A-Z0-9]{4,5}(?:-[A-Z0-9]{4,5}){2,3}(?![A-Za-z0-9-])", "token"),
    ("VSStufe", 1, "German classification", r"(?i)\bVS-(?:NfD|VERTRAULICH|GEHEIM)\b", "token"),
    ("StrengGeheim", 1, "Top secret", r"(?i)\bSTRENG[- _]?GEHEIM\b|\bTOP[- _]?SECRET\b", "line"),
    ("NATOStufe", 1, "NATO classification", r"(?i)\bNATO[- _](?:RESTRICTED|CONFIDENTIAL|SECRET|UNCLASSIFIED)\b", "line"),
    ("EUStufe", 1, "EU classification", r"(?i)\bRESTREINT[- _]UE\b|\bCONFIDENTIEL[- _]UE\b|\bEU[- _](?:RESTRICTED|CONFIDENTIAL|SECRET)\b", "line"),
    ("SGAktenzeichen", 2, "Social court file number", r"\bS ?\d{1,3} ?R ?\d{1,5}/\d{2}\b", "line"),
    ("SourceCodeURL", 3, "Source repository", r"(?i)(git@|git://|svn://|ssh://git|bitbucket\.org/|gitlab\.|github\.com/)", "token"),
]

#: Key→value rules (own patterns): name, severity, description, regular expression on the key token, offset of the value.
FIELD_RULES: list[tuple[str, int, str, str, int]] = [
    ("Passwort", 1, "Password field", r"(?i)(passw|kennw|\bpwd\b|passphrase)", 1),
    ("OraclePasswort", 1, "identified by <password>", r"(?i)^identified$", 2),
    ("Credential", 1, "Credential field", r"(?i)(credential|\bcred\b)", 1),
    ("ApiKey", 1, "API key field", r"(?i)\b(x-)?api[-_]?key\b", 1),
    ("ApiToken", 1, "API token field", r"(?i)\b(api|access|refresh|auth|id)[-_]?token\b", 1),
    ("ClientSecret", 1, "Client secret field", r"(?i)\bclient[-_]?secret\b", 1),
    ("SessionID", 2, "Session identifier field", r"(?i)\b(j?session[-_]?id)\b", 1),
    ("AuthHeader", 1, "Authorization header", r"(?i)^authorization:?$", 2),
    ("Bearer", 1, "Bearer token", r"(?i)^bearer$", 1),
    ("CloudKey", 1, "Cloud key field", r"(?i)\b(aws|azure|gcp)[-_](secret|key)\w*", 1),
    ("ProxyAuth", 1, "Proxy password field", r"(?i)\bproxy[-_](password|auth\w*)\b", 1),
    ("SmtpAuth", 1, "Mail password field", r"(?i)\bsmtp[-_](password|auth\w*)\b", 1),
    ("BindPW", 1, "Directory bind password field", r"(?i)\bbind[-_]?(pw|password)\b", 1),
    ("Benutzer", 4, "User field", r"(?i)^(user(name)?|login|benutzer(name)?)\b", 1),
    ("Vorname", 4, "First name field", r"(?i)\b(vorname|firstname|first_name)\b", 1),
    ("Nachname", 4, "Last name field", r"(?i)\b(nachname|lastname|last_name|surname)\b", 1),
    ("Geburtsdatum", 3, "Date of birth field", r"(?i)\b(geburtsdatum|birth_?date|date_of_birth|dob)\b", 1),
    ("Telefonfeld", 4, "Telephone field", r"(?i)\b(telefon|phone|mobile?)(_?(nr|number|nummer))?\b", 1),
    ("Kontonummer", 2, "Account number field", r"(?i)\b(kontonummer|account_?(no|number))\b", 1),
    ("RVNR", 2, "Pension number field", r"(?i)^(rvnr|vsnr)\b", 1),
]

#: Lexicons as (name, severity, entries).
LEXICONS: list[tuple[str, int, list[str]]] = [
    ("Diagnosen", 3, """Diabetes|Hypertonie|Asthma|Depression|Burnout|Migraene|Hepatitis|Chemotherapie|Psychotherapie|Schwangerschaft|Krebs|Tumor|Leukaemie|Lymphom|Karzinom|Melanom|Metastasen|Sarkom|Mammakarzinom|Prostatakarzinom|HIV|AIDS|Tuberkulose|Syphilis|MRSA|Sepsis|Malaria|Meningitis|Pneumonie|Influenza|Norovirus|Salmonellose|Borreliose|Epilepsie|Parkinson|Alzheimer|Demenz|Multiple Sklerose|Schlaganfall|Hirntumor|Neuropathie|Aphasie|Tremor|Ataxie|Schizophrenie|Bipolar|Manie|Psychose|Suizid|Anorexie|Bulimie|Angststoerung|Panikattacke|Zwangsstoerung|Autismus|ADHS|Herzinfarkt|Angina|Arrhythmie|Herzinsuffizienz|Thrombose|Embolie|Lungenembolie|Aneurysma|Endokarditis|Myokarditis|Arteriosklerose|COPD|Lungenfibrose|Pleuraerguss|Lungenkrebs|Bronchitis|Emphysem|Nierenversagen|Leberzirrhose|Dialyse|Transplantation|Organtransplantation|Nierentransplantation|Lebertransplantation|Amputation|Fraktur|Osteoporose|Rheuma|Arthritis|Fibromyalgie|Colitis|Morbus Crohn|Zoeliakie|Pankreatitis|Gallensteine|Glaukom|Katarakt|Makuladegeneration|Tinnitus|Hoersturz|Endometriose|Myom|Inkontinenz|Dialysepflichtig|Palliativ|Strahlentherapie|Immuntherapie|Beatmung|Intensivstation|Reanimation""".split("|")),
    ("Sicherheitsbegriffe", 3, """keystore truststore private_key privateKey secret_key secretKey vault-password encryption_key credentials token secret certificate signing_key hmac_secret jwt_secret session_secret api_secret webhook_secret oauth_token bearer_token master_key root_password admin_password service_account access_key connection_string cipher_key initialization_vector salt_value hash_secret pre_shared_key symmetric_key asymmetric_key key_pair decryption_key backup_key recovery_key escrow_key wrap_key key_alias credential_store password_vault secret_manager auth_token service_key deploy_key ssh_key pgp_key tls_certificate ssl_certificate client_certificate root_certificate""".split()),
    ("Verschlusssachen", 1, """VS-NfD VS-Vertraulich VS-Geheim Verschlusssache Verschlusssachen Geheimschutz Dienstgebrauch Geheimhaltungsgrad VS-Einstufung Verschlusssachenanweisung""".split()),
    ("Sperrvermerke", 1, """Sperrvermerk Auskunftssperre Uebermittlungssperre Übermittlungssperre Zeugenschutz Opferschutz Schutzvermerk Melderegistersperre""".split()),
]

#: Stop lists.
STOPWORDS: dict[str, list[str]] = {
    "regexp": ["0.0.0.0", "127.0.0.1", "hinweg", "vorweg", "umweg"],
    "field": "and für setzen wurden WITH YES at invalid java.sql.SQLException check for found generated in is parameter payload message note plan lab med code DEBUG ERROR ID INFO Kategorie Krit Classification".split(),
    "search": ["streng", "ernst", "stark"],
}
#: Technical terms that are never a name.
TECHNICAL_TERMS = "main root test prod auth user admin null none true false name host port path temp data info code type list item page home help mail http https json html demo guest system service".split()
#: A lexicon hit is of medium confidence on a line that contains one of these.
CONTEXT_MARKERS = "name vorname nachname firstname lastname surname person kunde customer patient mitarbeiter employee anschrift address adresse strasse straße wohnhaft geboren geburt ort stadt city".split()
#: The pre-filter's markers.
PREFILTER_MARKERS = "passw kennw pwd secret credential cred identified api_key apikey api-key x-api-key api_token access_token accesstoken bearer refresh_token refreshtoken jsessionid session_id sessionid client_secret clientsecret db.password jdbc.password authorization proxy_password smtp_password bind_password aws_key azure_secret gcp_key @ eyj -----begin jdbc: akia accountkey ghp_ gho_ ghu_ ghs_ ghr_ xox vs- nato geheim restreint confidentiel hra hrb".split()
#: Separators that a value look-ahead skips, and how many tokens it looks at.
FIELD_SEPARATORS, LOOKAHEAD = ["->", "=>", ":", "=", "==", "-->", "<<", ">>"], 4
#: Shortest regexp hit, shortest field token.
MIN_REGEXP, MIN_FIELD = 5, 3
#: Display names of derived findings, and what stands for a masked value.
SUFFIX = {"": "", "masked": " (maskiert)", "low": " (niedrige Konfidenz)", "incomplete": " (unvollstaendig)"}
MASKED_STATUS, CUT_MARK = "credential field present, value masked", "…[gekuerzt]"
SEVERITY_LABELS = {1: "kritisch", 2: "hoch", 3: "mittel", 4: "niedrig", 5: "info"}
#: Account number lengths by country.
IBAN_LENGTHS = {
    "DE": 22, "AT": 20, "CH": 21, "FR": 27, "GB": 22, "NL": 18, "BE": 16, "LU": 20, "IT": 27, "ES": 24, "PL": 28,
    "CZ": 24, "DK": 18, "SE": 24, "NO": 15, "FI": 18, "PT": 25, "IE": 22, "LI": 21, "SK": 24, "SI": 19, "EE": 20,
    "LV": 21, "LT": 20, "HU": 28, "HR": 21, "RO": 24, "BG": 22, "GR": 27, "CY": 28, "MT": 31, "IS": 26,
}
#: Words that end like streets but are none.
NO_STREETS = "speicherplatz arbeitsplatz fluchtweg loesungsweg rettungsweg irrweg holzweg ausweg loesungswege".split()
