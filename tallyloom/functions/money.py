"""Integer minor-unit money: parsing and formatting. Never floating point."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a rupee text must look like; anything else is an error, not a guess.
RUPEES = r"^-?[0-9]+([.][0-9]{1,2})?$"


def paise(text: Column) -> Column:
    """Rupee text to paise; a text of another form raises, null stays null."""
    value = (text.cast("decimal(20,2)") * 100).cast("long")
    return F.when(text.isNull() | text.rlike(RUPEES), value).otherwise(F.raise_error(F.concat(F.lit("not a rupee amount: "), text)).cast("long"))


def try_paise(text: Column) -> Column:
    """As ``paise``, but null for a text of another form."""
    return F.when(text.rlike(RUPEES), (text.cast("decimal(20,2)") * 100).cast("long"))


def rupees(amount: Column) -> Column:
    """Paise to rupee text, the inverse of ``paise``."""
    whole = div(F.abs(amount), 100)
    return F.concat(F.when(amount < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad((F.abs(amount) % 100).cast("string"), 2, "0"))


def inr(amount: Column) -> Column:
    """Paise as a rupee sign and thousands separators."""
    whole = div(F.abs(amount), 100)
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), F.format_number(whole, 0), F.lit("."), F.lpad((F.abs(amount) % 100).cast("string"), 2, "0"))


def div(a: Column, b: int) -> Column:
    """Whole division of non-negative longs."""
    return F.call_function("div", a, F.lit(b))


def ceil_div(a: Column, b: int) -> Column:
    """Whole division of non-negative longs, rounded up."""
    return div(a + (b - 1), b)


#: Basis points of a payment, and of cards of which network and type differ.
RATE = 200
CARD_RATES = {("Amex", "credit"): 300, ("Amex", "debit"): 300, ("Diners", "credit"): 300, ("RuPay", "debit"): 0}


def rate(network: Column, card_type: Column) -> Column:
    """Basis points of a payment; both are null but for cards."""
    out = F.lit(RATE)
    for (of_network, of_type), points in CARD_RATES.items():
        out = F.when((network == of_network) & (card_type == of_type), points).otherwise(out)
    return out


def computed_fee(amount: Column, network: Column, card_type: Column, taxed: Column | bool = True) -> Column:
    """(fee, tax): the fee includes its tax, so a payment's credit is its amount less the fee."""
    bare = fee(amount, rate(network, card_type))
    tax = F.when(taxed if isinstance(taxed, Column) else F.lit(taxed), gst(bare)).otherwise(0).cast("long")
    return F.struct((bare + tax).alias("fee"), tax.alias("tax"))


def fee(amount: Column, basis_points: Column) -> Column:
    """The processor's fee before tax, rounded up to a whole paisa."""
    return ceil_div(amount * basis_points, 10_000)


def gst(fee_: Column) -> Column:
    """18 % of a fee, rounded up."""
    return ceil_div(fee_ * 18, 100)


def net(credit: Column, debit: Column) -> Column:
    return credit - debit
