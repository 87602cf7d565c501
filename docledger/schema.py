"""The ledger row: 22 columns in contract order, their defaults and labels."""

# The column order and names are the import contract.
LEDGER = ("A_seq", "A_company_name", "B_doc_date", "C_reference", "D_vendor_code", "E_tax_id_13", "F_branch_5", "G_invoice_no", "H_invoice_date", "I_tax_purchase_date", "J_price_type", "K_account", "L_description", "M_qty", "N_unit_price", "O_vat_rate", "P_wht", "Q_payment_method", "R_paid_amount", "S_pnd", "T_note", "U_group")
DEFAULTS = {"A_seq": "1", "J_price_type": "1", "M_qty": "1", "N_unit_price": "0", "O_vat_rate": "7%", "P_wht": "0", "R_paid_amount": "0"}
# The headings of the import template, in column order.
TEMPLATE = (
    "ลำดับที่*", "ชื่อบริษัท", "วันที่เอกสาร", "อ้างอิงถึง", "ผู้รับเงิน/คู่ค้า", "เลขทะเบียน 13 หลัก", "เลขสาขา 5 หลัก", "เลขที่ใบกำกับฯ (ถ้ามี)", "วันที่ใบกำกับฯ (ถ้ามี)", "วันที่บันทึกภาษีซื้อ (ถ้ามี)", "ประเภทราคา",
    "บัญชี", "คำอธิบาย", "จำนวน", "ราคาต่อหน่วย", "อัตราภาษี", "หัก ณ ที่จ่าย (ถ้ามี)", "ชำระโดย", "จำนวนเงินที่ชำระ", "ภ.ง.ด. (ถ้ามี)", "หมายเหตุ", "กลุ่มจัดประเภท",
)
LABELS = ("No.", "Company", "Document date", "Reference", "Vendor", "Tax ID (13)", "Branch (5)", "Invoice no.", "Invoice date", "Tax claim date", "Price type", "Account", "Description", "Quantity", "Unit price", "VAT rate", "Withholding", "Payment", "Paid amount", "PND", "Note", "Group")
DATES = ("B_doc_date", "H_invoice_date", "I_tax_purchase_date")
GROUPS = {"META": "Advertising Expense", "GOOGLE": "Advertising Expense", "SHOPEE": "Marketplace Expense", "LAZADA": "Marketplace Expense", "TIKTOK": "Marketplace Expense", "SPX": "Delivery/Logistics Expense", "THAI_TAX": "General Expense", "UNKNOWN": "Other Expense"}
VENDOR_LABELS = {"META": "Meta Platforms Ireland", "GOOGLE": "Google Asia Pacific", "SHOPEE": "Shopee", "LAZADA": "Lazada", "TIKTOK": "TikTok", "SPX": "Shopee Express", "THAI_TAX": "", "UNKNOWN": ""}
