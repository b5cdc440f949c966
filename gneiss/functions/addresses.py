"""Addresses of people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains of throw-away mailboxes.
DISPOSABLE = (
    "mailinator.com", "mailinator.net", "tempmail.com", "temp-mail.org", "temp-mail.io", "tempmailaddress.com",
    "tempmail.us.com", "10minutemail.com", "10minutemail.net", "20minutemail.com", "guerrillamail.com",
    "guerrillamail.net", "guerrillamail.org", "guerrillamailblock.com", "sharklasers.com", "grr.la", "yopmail.com",
    "yopmail.net", "yopmail.fr", "trashmail.com", "trashmail.de", "trashmail.net", "trashmail.io", "getnada.com",
    "nada.email", "maildrop.cc", "mintemail.com", "fakeinbox.com", "throwawaymail.com", "mohmal.com", "inboxbear.com",
    "tempinbox.com", "spamgourmet.com", "mytemp.email", "emailondeck.com", "fakemail.net", "sogetthis.com",
    "mailcatch.com", "mailnesia.com", "tempr.email", "discard.email", "discardmail.com", "spamfree24.org",
    "mailforspam.com", "mt2014.com", "mt2015.com", "mvrht.com", "pokemail.net", "spam4.me", "wegwerfmail.de",
    "wegwerfmail.net", "wegwerfmail.org", "mail-temporaire.fr", "jetable.org", "binkmail.com", "gett.io",
    "bouncr.com", "spambog.com", "tempemail.net", "tempemail.com", "tempmail.ninja", "minutemail.com", "fivemail.de",
    "incognitomail.org", "spamspot.com", "tafmail.com", "tempinbox.co.uk", "tempmail.eu", "thismail.net", "tmail.ws",
    "mailimate.com", "easytrashmail.com", "cmail.club",
)


def domain(email: Column) -> Column:
    """What stands between the first @ of an address and a second one or its end, in lower case; null without any."""
    return F.nullif(F.lower(F.trim(F.get(F.split(email, "@"), F.lit(1)))), F.lit(""))


def is_disposable(email: Column) -> Column:
    """Whether an address is of a throw-away mailbox."""
    return F.coalesce(domain(email).isin(*DISPOSABLE), F.lit(False))
