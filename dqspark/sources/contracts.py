"""Declared schemas of the raw files."""

from __future__ import annotations

# File, separator and columns of the headerless files.
FLAT_FILES = {
    "raw_date": ("Date.txt", "|", "sk_dateid bigint, datevalue date, datedesc string, "
                 "calendaryearid int, calendaryeardesc string, calendarqtrid int, "
                 "calendarqtrdesc string, calendarmonthid int, calendarmonthdesc string, "
                 "calendarweekid int, calendarweekdesc string, dayofweeknum int, "
                 "dayofweekdesc string, fiscalyearid int, fiscalyeardesc string, fiscalqtrid int, "
                 "fiscalqtrdesc string, holidayflag boolean"),
    "raw_time": ("Time.txt", "|", "sk_timeid bigint, timevalue string, hourid int, hourdesc string, "
                 "minuteid int, minutedesc string, secondid int, seconddesc string, "
                 "markethoursflag boolean, officehoursflag boolean"),
    "raw_statustype": ("StatusType.txt", "|", "st_id string, st_name string"),
    "raw_taxrate": ("TaxRate.txt", "|", "tx_id string, tx_name string, tx_rate double"),
    "raw_tradetype": ("TradeType.txt", "|",
                      "tt_id string, tt_name string, tt_is_sell int, tt_is_mrkt int"),
    "raw_industry": ("Industry.txt", "|", "in_id string, in_name string, in_sc_id string"),
    "raw_dailymarket": ("DailyMarket.txt", "|", "dm_date date, dm_s_symb string, dm_close double, "
                        "dm_high double, dm_low double, dm_vol bigint"),
    "raw_trade": ("Trade.txt", "|", "t_id bigint, t_dts timestamp_ntz, t_st_id string, "
                  "t_tt_id string, t_is_cash int, t_s_symb string, t_qty bigint, "
                  "t_bid_price double, t_ca_id string, t_exec_name string, t_trade_price double, "
                  "t_chrg double, t_comm double, t_tax double"),
    "raw_tradehistory": ("TradeHistory.txt", "|",
                         "th_t_id bigint, th_dts timestamp_ntz, th_st_id string"),
    "raw_cashtransaction": ("CashTransaction.txt", "|", "ct_ca_id string, ct_dts timestamp_ntz, "
                            "ct_amt double, ct_name string"),
    "raw_holdinghistory": ("HoldingHistory.txt", "|", "hh_h_t_id bigint, hh_t_id bigint, "
                           "hh_before_qty bigint, hh_after_qty bigint"),
    "raw_watchhistory": ("WatchHistory.txt", "|", "w_c_id string, w_s_symb string, "
                         "w_dts timestamp_ntz, w_action string"),
    "raw_prospect": ("Prospect.csv", ",", "agencyid string, lastname string, firstname string, "
                     "middleinitial string, gender string, addressline1 string, "
                     "addressline2 string, postalcode string, city string, state string, "
                     "country string, phone string, income bigint, numbercars int, "
                     "numberchildren int, maritalstatus string, age int, creditrating int, "
                     "ownorrentflag string, employer string, numbercreditcards int, "
                     "networth bigint"),
    "raw_hr": ("HR.csv", ",", "employeeid bigint, managerid bigint, employeefirstname string, "
               "employeelastname string, employeemi string, employeejobcode int, "
               "employeebranch string, employeeoffice string, employeephone string"),
}

# Header contracts of the shop files (file -> table and columns).
SHOP_FILES = {
    "raw_customers.csv": ("raw_customers", "id string, name string"),
    "raw_order_items.csv": ("raw_items", "id string, order_id string, sku string"),
    "raw_orders.csv": ("raw_orders", "id string, customer string, ordered_at timestamp_ntz, "
                       "store_id string, subtotal bigint, tax_paid bigint, order_total bigint"),
    "raw_products.csv": ("raw_products", "sku string, name string, type string, price bigint, "
                         "description string"),
    "raw_stores.csv": ("raw_stores", "id string, name string, opened_at timestamp_ntz, "
                       "tax_rate double"),
    "raw_supplies.csv": ("raw_supplies", "id string, name string, cost bigint, "
                         "perishable boolean, sku string"),
}

# Slices of the fixed-width records (1-based start, length, type).
COMPANY = {"cik": (79, 10, "string"), "company_name": (19, 60, "string"),
           "status": (89, 4, "string"), "industry_id": (93, 2, "string"),
           "sp_rating": (95, 4, "string")}
SECURITY = {"symbol": (19, 15, "string"), "issue_type": (34, 6, "string"),
            "status": (40, 4, "string"), "security_name": (44, 70, "string"),
            "ex_id": (114, 6, "string"), "shares_outstanding": (120, 13, "bigint"),
            "dividend": (149, 12, "double"), "co_name_or_cik": (161, 60, "string")}
FINANCIAL = {"cik": (187, 60, "string"), "fin_year": (19, 4, "int"), "fin_qtr": (23, 1, "int"),
             "revenue": (40, 17, "double"), "earnings": (57, 17, "double"),
             "eps": (74, 12, "double"), "assets": (127, 17, "double"),
             "liabilities": (144, 17, "double")}
